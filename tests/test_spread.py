"""Per-document work is dealt out to all cores, however few parts a scan has, and set up once for all documents."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.test_documents import SALT, everything
from tests.test_guards import TEXTS
from umbra.operators import corpus
from umbra.plans import document, guards
from umbra.plans.document import Prepared, sanitise_text
from umbra.plans.policy import Policy
from umbra.plans.verification import verify


def one_part(spark, n=800):
    """Documents as a file of one row group gives them, with columns that can't be hashed among them."""
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("a"), F.expr("concat('enable secret S', id, '\\nssh-rsa AAAAC3Nza', id, '\\n')").alias("text"))
    return docs.withColumns({"m": F.create_map(F.lit("k"), "text"), "list": F.array("text")})


@pytest.mark.parametrize("run", [corpus.sanitise, corpus.survivors])
def test_one_part_keeps_all_cores_busy(spark, run):
    docs = one_part(spark)
    assert docs.select(F.spark_partition_id()).distinct().count() == 1
    rows = run(docs).groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("a").alias("n")).collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism
    assert sum(r.n for r in rows) == 800
    assert max(r.n for r in rows) < 200


def test_documents_are_folded_in_parts(spark):
    got = corpus.sanitise(one_part(spark, 3 * corpus.AT_ONCE + 1).repartition(1)).select(F.sum("a"), F.count("m")).first()
    n = 3 * corpus.AT_ONCE + 1
    assert tuple(got) == (n * (n - 1) // 2, n)


@pytest.mark.parametrize("action", ["keep", "hash", "redact"])
def test_grouped_guards_leave_the_outcome(action, monkeypatch):
    policy = Policy(everything(action))
    prepared = Prepared(policy)
    guarded = [document.Sanitiser(policy, SALT, prepared=prepared).run(t) for t in TEXTS]
    left = [verify(t.splitlines(), policy, prepared=prepared) for t in TEXTS]
    monkeypatch.setattr(guards.Present, "among", lambda self, group: group.items)
    for t, o, found in zip(TEXTS, guarded, left, strict=True):
        assert sanitise_text(t, policy, SALT) == o
        assert verify(t.splitlines(), policy) == found


def test_setting_up_is_not_repeated(monkeypatch):
    made = []
    monkeypatch.setattr(Policy, "rules", lambda self, given=Policy.rules: made.append(1) or given(self))
    policy = Policy(everything("hash"))
    prepared = Prepared(policy)
    for i in range(20):
        assert corpus.fold(f"hostname sw{i}\n", None, policy, SALT, prepared)["counts"] == [("hostnames", 1)]
    assert len(made) == 1


def test_groups_pick_in_order_and_stay_bounded(monkeypatch):
    group = guards.Group([re.compile(p) for p in ("ab", "a?", "cd|ef", "gh")] + [None], lambda p: p)
    assert [p and p.pattern for p in group.likely("xx ef ab")] == ["ab", "a?", "cd|ef", None]
    monkeypatch.setattr(guards.Group, "KEPT", 2)
    for text in ("ab", "cd", "gh", "ab gh", "ab cd"):
        group.likely(text)
        assert len(group.picked) <= 2


@pytest.mark.parametrize("text", ["x" * 500, "plain é words " * 60, "set Password K ſecret \ud800 host-name " * 40, "-----BEGIN ssh-rsa $9$ %#%# router bgp 1 as-path interface" * 9, "ab", "a"])
def test_literals_of_long_texts_are_those_that_it_holds(text, monkeypatch):
    low = text.lower()
    found = {x for x in guards.LITERALS.known if x in low}
    assert guards.LITERALS.held(low) == found
    monkeypatch.setattr(guards.Literals, "LONG", 0)
    assert guards.LITERALS.held(low) == found


@pytest.mark.parametrize("line", ["sw1 Sw1-x x-sw1 _sw1 sw1_ (SW1) sw1sw1 sw1.sw1", "sw1", "xsw1", "é sw1 ésw1", "sw1 sw1"])
def test_names_are_replaced_where_they_stand_by_themselves(line):
    o = sanitise_text(f"hostname sw1\n! {line}\n", Policy({"policy": {"hostnames": "redact"}}), SALT)
    want, n = re.subn(r"(?<![\w-])sw1(?![\w-])", "redacted", line, flags=re.I)
    assert o.lines[1] == f"! {want}"
    assert o.counts["hostnames"] == n + 1


def test_ignored_spans_of_a_text_are_all_that_it_can_hold():
    from umbra.plans import rulebook as book
    from umbra.plans import verification

    whole = re.compile("|".join(book.IGNORED), re.I)
    for text in [*TEXTS, "<SECRET-0a1b2c> no service password-encryption", "/user add x\nconfig set y\ncommunity 1:2 key chain KEY-CHAIN secretdata"]:
        pattern = verification._ignored(guards.Present(text).among(verification._IGNORED), ())
        for line in text.splitlines():
            assert (pattern.sub(" ", line) if pattern else line) == whole.sub(" ", line)


def test_a_changed_line_meets_only_the_rules_that_it_can_match():
    group = Prepared(Policy()).rules
    line, decide = "enable secret 5 $1$ab$cd", lambda name, family, value: "<REMOVED>"
    assert document.rewrite(line, frozenset(), group.items, decide) == document.rewrite(line, frozenset(), guards.Present(line).among(group), decide, group)
    assert len(group.after(guards.Present("enable secret 5 <REMOVED>"), group.items[0])) < 20
