"""Rules as Catalyst expressions, for policies without allocation (keep, hash, redact, and tokens for rule values).

A rule that reads its line several times is bound once by a lambda, so a chain of rules stays linear in the plan, with
or without a filter on its result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.digests import tag
from umbra.plans import rulebook as book
from umbra.plans.rendering import constant, naming


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def java(pattern: str, exact: bool = False) -> str:
    return ("(?U)" if exact else "(?iU)") + pattern


def _top_groups(pattern: str) -> list[tuple[int, int]]:
    """Spans of the capturing groups; none nests in these patterns."""
    out, i, depth, start, in_class = [], 0, 0, None, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += 1 if pattern[i + 1 : i + 2] == "]" else 2 if pattern[i + 1 : i + 3] == "^]" else 0
        elif c == "(":
            depth += 1
            if pattern[i + 1] != "?" and start is None:
                start = (i, depth)
        elif c == ")":
            if start and start[1] == depth:
                out.append((start[0], i + 1))
                start = None
            depth -= 1
        i += 1
    return out


def _parens(pattern: str) -> list[tuple[int, int, int]]:
    """(start, end, depth) of all groups, by their start."""
    out, stack, i, in_class = [], [], 0, False
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if in_class:
            in_class = pattern[i] != "]"
        elif pattern[i] == "[":
            in_class = True
            i += 1 if pattern[i + 1] == "]" else 2 if pattern[i + 1 : i + 3] == "^]" else 0
        elif pattern[i] == "(":
            stack.append(i)
        elif pattern[i] == ")":
            start = stack.pop()
            out.append((start, i + 1, len(stack)))
        i += 1
    return sorted(out)


def _options(branch: str) -> list[str]:
    """A branch whose second value stands in an optional group: once with that group, once without."""
    groups = _parens(branch)
    for start, end, depth in groups:
        if depth == 0 and branch[start : start + 3] == "(?:" and branch[end : end + 1] == "?":
            if any(start < a and b < end and branch[a + 1] != "?" for a, b, _ in groups):
                return [branch[:start] + branch[start + 3 : end - 1] + branch[end + 1 :], branch[:start] + branch[end + 1 :]]
    return [branch]


def _branches(rule: book.Rule) -> list[str]:
    """The alternatives of a rule, each with its values at the top level."""
    return [o for b in _alternatives(rule) for o in _options(b)]


def _alternatives(rule: book.Rule) -> list[str]:
    p = rule.expanded
    if rule.form == "prefix" or not p.startswith("(?:"):
        return [p]
    depth, cuts, in_class, i = 0, [3], False, 0
    while i < len(p):
        if p[i] == "\\":
            i += 2
            continue
        in_class = p[i] == "[" or (in_class and p[i] != "]")
        if not in_class:
            depth += (p[i] == "(") - (p[i] == ")")
            if p[i] == "|" and depth == 1:
                cuts.append(i + 1)
            if depth == 0 and i < len(p) - 1:
                return [p]  # the group ends before the pattern does
        i += 1
    return [p[a : (b - 1)] for a, b in zip(cuts, [*cuts[1:], len(p)], strict=True)]


def _spelled(branch: str, anchored: bool) -> tuple[str, int]:
    """The branch with all between its values captured too: (before)(value)(between)...(after); and the number of values."""
    spans = _top_groups(branch)
    body, at = "", 0
    for a, b in spans:
        body += f"({branch[at:a]}){branch[a:b]}"
        at = b
    body += f"({branch[at:]})"
    return (f"^(?:{body})(.*)$" if anchored else f"^{body}$"), len(spans)


def rendered(rule: book.Rule, action: str, value: Column, salt: bytes) -> Column:
    marker, token = naming(rule.name, rule.family)
    if action == "redact":
        return F.lit(constant(rule.name, rule.family))
    mark = tag(salt, marker.lower(), value)
    return F.concat(F.lit(f"<{marker}-"), mark, F.lit(">")) if action == "hash" else F.concat(F.lit(f"{token}-"), mark)


def _own(rule: book.Rule, value: Column) -> Column:
    marker, token = naming(rule.name, rule.family)
    shapes = [f"<{marker}-[0-9a-f]{{1,6}}>", re.escape(book.REMOVED), re.escape(book.CONSTANTS.get(rule.family, book.REMOVED)), *([f"{token}-[0-9a-f]{{1,6}}"] if token else [])]
    return F.trim(value).rlike(f"^(?:{'|'.join(shapes)})$")


def _value(rule: book.Rule, action: str, raw: Column, salt: bytes) -> Column:
    """A selected value rendered inside its quotes; blank ones and own renderings stay."""

    def body(v: Column) -> Column:
        quoted = (F.length(v) > 1) & v.rlike("""^(["']).*\\1$""")
        bare = F.when(quoted, F.regexp_replace(v, """^["']|["']$""", "")).otherwise(v)
        quote = F.when(quoted, F.substring(v, 1, 1)).otherwise("")
        return F.when((F.trim(v) == "") | (bare == "") | _own(rule, bare), v).otherwise(F.concat(quote, rendered(rule, action, bare, salt), quote))

    return let(raw, body)


def _spliced(rule: book.Rule, branch: str, action: str, text: Column, salt: bytes, anchored: bool) -> tuple[Column, Column]:
    """(whether the branch matches, the text with its values rendered)."""
    spelled, values = _spelled(branch, anchored)
    rx = java(spelled, rule.name in book.CASE_SENSITIVE)
    parts = []
    for k in range(values):
        parts += [F.regexp_extract(text, rx, 2 * k + 1), _value(rule, action, F.regexp_extract(text, rx, 2 * k + 2), salt)]
    parts += [F.regexp_extract(text, rx, 2 * values + 1), *([F.regexp_extract(text, rx, 2 * values + 2)] if anchored else [])]
    return text.rlike(rx), F.concat(*parts)


def apply_rule(rule: book.Rule, action: str, text: Column, salt: bytes = b"", scopes: Column | None = None) -> Column:
    """One rule over one line."""
    if action == "keep":
        return text

    def matched(t: Column) -> Column:
        if rule.form == "prefix":
            rx = java(rule.expanded)
            new = F.concat(F.regexp_extract(t, rx, 1), _value(rule, action, F.regexp_extract(t, rx, 2), salt), F.regexp_extract(t, rx, 3))
            return F.when(t.rlike(rx), new).otherwise(t)
        if rule.form == "host":
            words = F.split(F.trim(F.regexp_extract(t, java(rule.expanded), 1)), r"\s+")
            keyword = lambda w: F.lower(w).isin(*book.HOST_WORDS)
            first = F.coalesce(F.array_position(F.transform(words, keyword), F.lit(False)), F.lit(0))
            new = F.array_join(F.transform(words, lambda w, i: F.when(i + 1 == first, _value(rule, action, w, salt)).otherwise(w)), " ")
            head = F.regexp_extract(t, java(r"^(\s*snmp-server\s+host\s+\S+\s+)"), 1)
            return F.when(t.rlike(java(rule.expanded)), F.concat(head, new)).otherwise(t)
        out = None
        for branch in _branches(rule):
            hit, new = _spliced(rule, branch, action, t, salt, True)
            out = (F if out is None else out).when(hit, new)
        return out.otherwise(t)

    def searched(t: Column) -> Column:
        rx = java(rule.expanded, rule.name in book.CASE_SENSITIVE)

        def one(m: Column) -> Column:
            out = None
            for branch in _branches(rule):
                hit, new = _spliced(rule, branch, action, m, salt, False)
                out = (F if out is None else out).when(hit, new)
            return out.otherwise(m)

        found = F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(0)), one)
        between = F.split(t, rx, -1)
        woven = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(t.rlike(rx), woven).otherwise(t)

    new = let(text, searched if rule.form == "search" else matched)
    if scopes is None or not (rule.inside or rule.outside):
        return new
    inside = F.array_contains(scopes, rule.inside) if rule.inside else F.lit(True)
    outside = ~F.array_contains(scopes, rule.outside) if rule.outside else F.lit(True)
    return F.when(inside & outside, new).otherwise(text)


def _applied(rule: book.Rule, action: str, salt: bytes, scopes: Column) -> Callable[[Column], Column]:
    return lambda text: apply_rule(rule, action, text, salt, scopes)


def apply_rules(rules: tuple[book.Rule, ...], action_of: Callable[[str], str], text: Column, scopes: Column, salt: bytes = b"") -> Column:
    """The ordered chain as one expression, for up to about twenty rules: each sees what those before it left."""
    for rule in rules:
        if (action := action_of(rule.name)) != "keep":
            text = let(text, _applied(rule, action, salt, scopes))
    return text


def rewritten(lines: DataFrame, column: str, scopes: str, rules: tuple[book.Rule, ...], action_of: Callable[[str], str], salt: bytes = b"", step: int = 12) -> DataFrame:
    """The whole ordered chain over a column of lines, a few rules a projection so that analysis stays shallow."""
    acting = [r for r in rules if action_of(r.name) != "keep"]
    for i in range(0, len(acting), step):
        lines = lines.withColumn(column, apply_rules(tuple(acting[i : i + step]), action_of, F.col(column), F.col(scopes), salt))
    return lines
