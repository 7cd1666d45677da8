"""The policy: which selector gets which action. Plain data on the driver, validated before any input is read."""

from __future__ import annotations

import ipaddress
import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from umbra.plans import rulebook as book


class PolicyError(ValueError):
    """A policy that names an unknown selector or gives it an action that it can't have."""


#: section: (selectors with a `default` that they inherit, settings of other types with their defaults)
SECTIONS: dict[str, tuple[tuple[str, ...], dict[str, object]]] = {
    **{f: (tuple(r for r, home in book.RULE_FAMILY.items() if home == f), {}) for f in book.RULE_FAMILIES},
    "ipv4": (book.V4_NAMES, {"pool": list(book.V4_POOLS), "well_known_resolvers": list(book.V4_RESOLVERS), "keep_networks": []}),
    "ipv6": (book.V6_NAMES, {"pool": book.V6_POOL, "well_known_resolvers": list(book.V6_RESOLVERS), "keep_networks": []}),
    "operational-names": (tuple(book.OPERATIONAL), {}),
    "as-numbers": ((), {}),
}
FLAT = {"policy": book.NAME_FAMILIES, "macs": ("oui", "nic")}
OTHER = {
    "macs": {"pool": book.MAC_POOL},
    "collection": {"strip_diagnostics": True},
    "verify": {"enabled": True, "disable": [], "ignore_patterns": []},
    "": {"salt_file": "", "marker": True, "vendor": "auto"},
}
VENDORS = ("auto", *sorted(book.VENDOR_HINTS))
CHECK_NAMES = (*[n for n, _, _ in book.CHECKS], *book.MORE_CHECKS)


def _start(section: str) -> dict[str, object]:
    if section in SECTIONS:
        return {"default": "redact" if section == "secrets" else "keep"} | {k: (list(v) if isinstance(v, list) else v) for k, v in SECTIONS[section][1].items()}
    return dict.fromkeys(FLAT.get(section, ()), "keep") | {k: (list(v) if isinstance(v, list) else v) for k, v in OTHER.get(section, {}).items()}


@dataclass
class Policy:
    """Sections as dictionaries; a selector that a section doesn't name inherits its `default`."""

    sections: dict[str, dict] = field(default_factory=dict)
    custom: list[book.Rule] = field(default_factory=list)

    def __post_init__(self) -> None:
        given, self.sections = self.sections, {s: _start(s) for s in (*SECTIONS, *FLAT, "collection", "verify", "")}
        for section, values in given.items():
            self.set(section, values)
        self.validate()

    def set(self, section: str, values: dict) -> None:
        if section not in self.sections:
            raise PolicyError(f"unknown section [{section}]; expected one of {', '.join(s for s in self.sections if s)}")
        known = {"default", *SECTIONS[section][0], *SECTIONS[section][1]} if section in SECTIONS else set(_start(section))
        for key in values:
            if key in known:
                continue
            home = next((s for s, (names, _) in SECTIONS.items() if key in names), None) or next((s for s, names in FLAT.items() if key in names), None)
            raise PolicyError(f"[{section}] has no key {key!r}" + (f"; it belongs to [{home}]" if home else ""))
        self.sections[section] |= values

    # -- resolution
    def action(self, section: str, selector: str) -> str:
        values = self.sections[section]
        if section in FLAT:
            return values[selector]
        return values.get(selector) or values["default"]

    def rule_action(self, name: str) -> str:
        for c in self.custom:
            if c.name == name:
                return c.action or self.sections[c.family]["default"] if c.family in SECTIONS else c.action or self.family_action(c.family)
        if name not in book.RULE_FAMILY:
            raise PolicyError(f"unknown rule {name!r}")
        return self.action(book.RULE_FAMILY[name], name)

    def family_action(self, family: str) -> str:
        if family in book.NAME_FAMILIES:
            return self.sections["policy"][family]
        if family == "macs":
            oui, nic = self.sections["macs"]["oui"], self.sections["macs"]["nic"]
            return oui if oui == nic else "pseudo"
        if family not in self.sections:
            raise PolicyError(f"unknown family {family!r}")
        return self.sections[family]["default"]

    def active(self, section: str) -> bool:
        """Whether any selector of the section is acted on."""
        if section == "macs":
            return {self.sections["macs"][k] for k in FLAT["macs"]} != {"keep"}
        names = SECTIONS[section][0]
        return any(self.action(section, n) != "keep" for n in names) if names else self.sections[section]["default"] != "keep"

    def rules(self) -> tuple[book.Rule, ...]:
        return book.rule_order(tuple(self.custom))

    # -- validation
    def validate(self) -> None:
        for section, values in self.sections.items():
            names = {"default", *SECTIONS[section][0]} if section in SECTIONS else set(FLAT.get(section, ()))
            for key in names & set(values):
                _check(f"[{section}] {key}", section, values[key])
        macs = self.sections["macs"]
        if "hash" in (macs["oui"], macs["nic"]) and macs["oui"] != macs["nic"]:
            raise PolicyError("macs: hash applies to the whole address; set both oui and nic to hash")
        if not isinstance(macs["pool"], str) or len(re.sub(r"[^0-9A-Fa-f]", "", macs["pool"])) < 6:
            raise PolicyError("[macs] pool must hold six hex digits")
        for name, version, longest in (("ipv4", 4, 24), ("ipv6", 6, 64)):
            pools = self.sections[name]["pool"]
            pools = [pools] if isinstance(pools, str) else pools
            if not pools:
                raise PolicyError(f"[{name}] pool must not be empty")
            for text in (*pools, *self.sections[name]["keep_networks"]):
                try:
                    net = ipaddress.ip_network(text)
                except ValueError as e:
                    raise PolicyError(f"[{name}] {text!r}: {e}") from e
                if text in pools and (net.version != version or net.prefixlen > longest):
                    raise PolicyError(f"[{name}] pool {text!r} must be an IPv{version} network of /{longest} or shorter")
        unknown = set(self.sections["verify"]["disable"]) - set(CHECK_NAMES)
        if unknown:
            raise PolicyError(f"verify.disable names unknown checks: {', '.join(sorted(unknown))}")
        for p in self.sections["verify"]["ignore_patterns"]:
            try:
                re.compile(p)
            except re.error as e:
                raise PolicyError(f"[verify] ignore_patterns {p!r}: {e}") from e
        if self.sections[""]["vendor"] not in VENDORS:
            raise PolicyError(f"vendor must be one of {', '.join(VENDORS)}")
        seen = set(book.RULE_FAMILY)
        for c in self.custom:
            if c.name in seen:
                raise PolicyError(f"custom rule {c.name!r}: the name is taken")
            seen.add(c.name)
            if c.family not in book.FAMILIES:
                raise PolicyError(f"custom rule {c.name!r}: unknown family {c.family!r}")
            if c.action is not None:
                _check(f"custom rule {c.name!r}", c.family, c.action)

    # -- text forms
    @classmethod
    def from_dict(cls, data: dict) -> Policy:
        data = dict(data)
        custom = [book.custom_rule(**c) for c in data.pop("custom", [])]
        top = {k: data.pop(k) for k in list(data) if not isinstance(data[k], dict)}
        return cls({"": top, **data}, custom)

    @classmethod
    def load(cls, path: str | Path | None = None) -> Policy:
        """From a TOML file; without a path from ./umbra.toml, ./.umbra.toml or the user's configuration folder, if any."""
        found = [Path(path)] if path else [p for p in (Path("umbra.toml"), Path(".umbra.toml"), Path.home() / ".config/umbra/config.toml") if p.exists()]
        if not found:
            return cls()
        try:
            return cls.from_dict(tomllib.loads(found[0].read_text(encoding="utf-8")))
        except tomllib.TOMLDecodeError as e:
            raise PolicyError(f"{found[0]}: {e}") from e

    def to_toml(self) -> str:
        """All keys at their resolved values; loads back to an equal policy."""
        out = [f"{k} = {_toml(v)}" for k, v in self.sections[""].items()]
        for section, values in self.sections.items():
            if section:
                names = SECTIONS.get(section, ((), {}))[0]
                rows = values | {n: self.action(section, n) for n in names}
                out += ["", f"[{section}]", *[f"{_toml_key(k)} = {_toml(v)}" for k, v in rows.items()]]
        for c in self.custom:
            out += ["", "[[custom]]", *[f"{k} = {_toml(v)}" for k, v in (("name", c.name), ("pattern", c.pattern), ("family", c.family), ("action", c.action), ("stanza", c.inside)) if v]]
        return "\n".join(out) + "\n"

    def rows(self) -> list[tuple[str, str, str]]:
        """(section, selector, action) for every selector there is."""
        out = [(s, n, self.action(s, n)) for s, (names, _) in SECTIONS.items() for n in (names or ("default",))]
        out += [(s, n, self.action(s, n)) for s, names in FLAT.items() for n in names]
        return out + [("custom", c.name, self.rule_action(c.name)) for c in self.custom]

    def summary(self) -> str:
        """What is acted on, in one line."""
        parts, kept = [], 0
        for section, (names, _) in SECTIONS.items():
            base = self.sections[section]["default"]
            odd = [f"{n}={self.action(section, n)}" for n in names if self.action(section, n) != base]
            if base != "keep" or odd:
                parts.append(f"{section}={base}" + (f" ({', '.join(odd)})" if odd else ""))
            else:
                kept += 1
        for section, names in FLAT.items():
            parts += [f"{n}={self.sections[section][n]}" for n in names if self.sections[section][n] != "keep"]
            kept += sum(self.sections[section][n] == "keep" for n in names)
        return ", ".join(parts) + (", everything else kept" if kept else "")


def _check(where: str, family: str, action: object) -> None:
    if not isinstance(action, str) or action not in book.ACTIONS:
        raise PolicyError(f"{where}: unknown action {action!r}; expected one of {', '.join(book.ACTIONS)}")
    if action == "pseudo" and family == "secrets":
        raise PolicyError(f"{where}: secrets have no pseudo form; use hash or redact")


def _toml(v: object) -> str:
    return "true" if v is True else "false" if v is False else json.dumps(v)


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k)
