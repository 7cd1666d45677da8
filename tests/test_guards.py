"""Literals that stand for patterns: they never rule out a match, and leave the outcome as it is."""

from __future__ import annotations

import re

import pyarrow.parquet as pq
import pytest

from tests.test_documents import SALT, SAMPLE, everything
from umbra.plans import document, guards, verification
from umbra.plans import rulebook as book
from umbra.plans.document import sanitise_text
from umbra.plans.policy import Policy
from umbra.plans.structure import logical_lines

TEXTS = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()][:40] + [
    SAMPLE, SAMPLE.upper(), SAMPLE + "\u017fet x \u0130\n", "set system host-name a\nsystem {\n  location { building 1; }\n}\n", "config system interface\n edit \"x\"\nend\n",
    "snmp-server host 10.0.0.1 informs c0mm x\nenable secret S\n description snmp-server community S\n", "/user\nadd name=a password=b comment=c\n",
]


@pytest.mark.parametrize("pattern, wanted", [("abc", {"abc"}), ("(?:ab|cd)+x?", {"ab", "cd"}), ("a?b*", None), (r"\bSet\s+key", {"set"}), ("(?!x)ab(c|d)", {"ab"})])
def test_needs(pattern, wanted):
    assert guards.needs(re.compile(pattern, re.I)) == (wanted and frozenset(wanted))


def test_no_match_is_ruled_out():
    patterns = [r.regex for r in book.RULES] + [re.compile(p, re.I) for _, _, p, *_ in book.OPERATIONAL_STEPS] + [re.compile(p) for _, p, _ in book.CHECKS]
    for text in TEXTS:
        for line in text.splitlines():
            present = guards.Present(line)
            assert all(present.may(p) for p in patterns if p.search(line))


@pytest.mark.parametrize("action", ["keep", "hash", "redact"])
def test_the_outcome_stays(action, monkeypatch):
    guarded = [sanitise_text(t, Policy(everything(action)), SALT) for t in TEXTS]
    monkeypatch.setattr(guards.Present, "may", lambda self, p: True)
    monkeypatch.setattr(document, "_QUAD_HINT", re.compile(""))
    monkeypatch.setattr(document, "_MAC_HINT", re.compile(""))
    for t, o in zip(TEXTS, guarded, strict=True):
        assert sanitise_text(t, Policy(everything(action)), SALT) == o


def test_what_is_left_is_found():
    policy = Policy(everything("redact"))
    lines = ["contact a@b.test", "ntp server 10.0.0.1", "mac-address 001b44aa0001", "router bgp 65001", "route-map x permit 1", "snmp-server location Hall"]
    assert {c for _, c, _ in verification.verify(lines, policy)} == {"email-left", "ipv4-left", "mac-left", "as-number-left", "operational-name-left", "location-left"}
    assert verification.verify(["ntp server 192.0.2.0", "plain words"], policy) == []


@pytest.mark.parametrize("wrapped, joined", [
    ([' ont add 0 1 password-auth "ab', 'cd" ont-srvprofile-id 2'], [' ont add 0 1 password-auth "abcd" ont-srvprofile-id 2']),
    ([" ont add 0 1 password-auth x ont-srvpro", "file-id 3", "return"], [" ont add 0 1 password-auth x ont-srvprofile-id 3", "return"]),
    ([" ont add 0 1 password-auth x", " vlan 7"], [" ont add 0 1 password-auth x", " vlan 7"]), (["add x=1 \\"], ["add x=1 \\"]), (["/user add x \\", "  y", "z"], ["/user add x y", "z"]),
])
def test_wraps(wrapped, joined):
    assert logical_lines(wrapped) == joined
