"""The per-document tier: contracts by selector and action, structure, idempotence, and the second look."""

from __future__ import annotations

import pytest

from umbra.plans import rulebook as book
from umbra.plans.document import sanitise_text, vendor_of
from umbra.plans.policy import CHECK_NAMES, Policy, PolicyError
from umbra.plans.rendering import Renderer, SpaceExhausted, address_class, mask_like
from umbra.plans.structure import configuration_only, logical_lines

SALT = b"deterministic-test-salt-do-not-use-in-anger"


def out(text, sections=None, **more):
    return sanitise_text(text, Policy(sections or {}), SALT, **more)


def everything(action):
    return {f: {"default": action} for f in (*book.RULE_FAMILIES, "ipv4", "ipv6", "operational-names", "as-numbers") if not (f == "secrets" and action == "pseudo")} | {
        "policy": dict.fromkeys(book.NAME_FAMILIES, action), "macs": {"oui": action, "nic": action}}


SAMPLE = """hostname core-rtr-01
ip domain-name corp.test
username netops secret 5 hunter2
snmp-server location Hall 4
interface Ethernet1
 description uplink
 ip address 10.1.2.3 255.255.255.0
 mac-address 001122aabbcc
router bgp 65001
 bgp confederation 2a00:1450::1 remote-as 3356
banner motd ^
hello
^
contact bob@corp.test
"""


@pytest.mark.parametrize("kind, value, digits, tag", [
    ("host", "core-rtr-01", 6, "a99da0"), ("secret", "hunter2", 6, "ced7b7"), ("desc", "a description", 6, "3cc015"),
    ("hostname", "core-rtr-01#0", 6, "9d04bf"), ("username", "netops#0", 4, "ca31")])
def test_tags_under_a_fixed_salt(kind, value, digits, tag):
    assert Renderer(SALT, Policy()).tag(kind, value, digits) == tag


@pytest.mark.parametrize("family", [f for f in book.FAMILIES])
@pytest.mark.parametrize("action", book.ACTIONS)
def test_legal_actions(family, action):
    section = "policy" if family in book.NAME_FAMILIES else family
    values = {"oui": action, "nic": action} if family == "macs" else {family if section == "policy" else "default": action}
    if (family, action) == ("secrets", "pseudo"):
        with pytest.raises(PolicyError):
            Policy({section: values})
    else:
        Policy({section: values})


@pytest.mark.parametrize("action", ["hash", "redact"])
def test_a_second_run_changes_nothing(action):
    once = out(SAMPLE, everything(action))
    twice = out(once.text, everything(action))
    assert twice.text == once.text
    assert not twice.counts


@pytest.mark.parametrize("action", ["pseudo", "hash", "redact"])
def test_output_verifies_clean(action):
    assert out(SAMPLE, everything(action)).findings == []


def test_nothing_but_secrets_by_default():
    o = out(SAMPLE)
    assert o.text == SAMPLE.replace("hunter2", "<REMOVED>")
    assert o.counts == {"username-secret": 1}


def test_keep_counts_and_leaves_the_value_to_later_rules():
    o = out("enable secret 5 $1$ab$cd\n", {"secrets": {"enable-secret": "keep"}})
    assert o.text == "enable secret 5 <REMOVED>\n"
    assert (o.kept_counts, o.counts) == ({"enable-secret": 1}, {"crypt-hash": 1})


def test_empty_text_and_null_stay_empty():
    assert (out("").text, out("").counts) == ("", {})


@pytest.mark.parametrize("text, expected", [
    ("set password ENC abc", "set password ENC <REMOVED>"), ("ntp server 10.0.0.1 key 5 prefer", None), ("location {", None), ('key "a b"', 'key "<REMOVED>"'),
    ("password 0 12345678", "password 0 <REMOVED>"), ("authentication-key /* SECRET-DATA */;", None), ('enable secret ""', None),
    ("snmp-server host 10.0.0.1   informs  c0mm  x", "snmp-server host 10.0.0.1   informs <REMOVED> x")])
def test_lines(text, expected):
    assert out(f"{text}\n").text == f"{expected or text}\n"


def test_scope_decides_the_owner_of_a_description():
    o = out("interface Eth1\n description a\nvrf x\n description b\n", {"interfaces": {"default": "hash"}})
    assert [h.rule for h in o.hits if h.action != "keep"] == ["interface-description"]


@pytest.mark.parametrize("wrapped, joined", [
    (["add a=\"x\\", "  y\" b=1"], ["add a=\"xy\" b=1"]), (["add x \\", " y \\", " z"], ["add x y z"]), (["text \\", "y"], ["text \\", "y"]),
    ([' ont add 0 0 desc "Shop', "Ltd\" ont-srvprofile-id 1", "#"], [' ont add 0 0 desc "ShopLtd" ont-srvprofile-id 1', "#"])])
def test_wrapped_commands(wrapped, joined):
    assert logical_lines(wrapped) == joined
    assert logical_lines(joined) == joined


def test_collector_sections():
    lines = ["! Command: show version", "x", "! Command: show running-config", "hostname a"]
    assert configuration_only(lines) == (["hostname a"], [("show version", 2), ("collector metadata", 1)])
    assert configuration_only(["hostname a"]) == (["hostname a"], [])


@pytest.mark.parametrize("number, masked", [(0xFFFFFF00, True), (0x000000FF, True), (0xE0000000, True), (0x0A000001, False), (1, True)])
def test_masks(number, masked):
    assert mask_like(number) is masked


@pytest.mark.parametrize("text, name", [("10.1.1.1", "rfc1918"), ("8.8.8.8", "other_unicast"), ("255.255.255.255", "reserved"), ("::1", "loopback"), ("2001:db8::1", "documentation")])
def test_address_classes(text, name):
    assert address_class(text) == name


def test_a_full_pool_fails_instead_of_reusing():
    with pytest.raises(SpaceExhausted):
        out("ip host 10.0.0.1\nip host 10.0.1.1\n", {"ipv4": {"default": "pseudo", "pool": ["198.18.0.0/24"]}})


def test_pseudonyms_keep_the_relation():
    o = out("a 10.0.0.1 b 10.0.0.9 c 10.0.1.1\n", {"ipv4": {"default": "pseudo"}})
    a, b, c = o.text.split()[1::2]
    assert a.rsplit(".", 1)[0] == b.rsplit(".", 1)[0] != c.rsplit(".", 1)[0]
    assert a.endswith(".1") and b.endswith(".9")


def test_kept_secret_is_a_finding_and_kept_identity_is_not():
    assert [f[1] for f in out("enable secret S\n", {"secrets": {"default": "keep"}}).findings] == ["credential-left"]
    assert out("checksum sha-256 " + "a1" * 16 + "\n").findings == []


def test_labels_leave_the_accounts():
    o = out("hostname sw1\n", {"policy": {"hostnames": "hash"}}, labels={"f": "sw1_sw1.cfg"})
    assert o.labels["f"].count("<HOST-") == 2
    assert o.counts["hostnames"] == 1


@pytest.mark.parametrize("vendor, text", [("juniper", "system {\n"), ("cisco", "Building configuration\n"), ("huawei", "sysname x\n"), ("unknown", "x\n")])
def test_vendor(vendor, text):
    assert vendor_of(text) == vendor


def test_policy_round_trip_and_errors():
    p = Policy({"identity": {"serial-number": "hash"}, "ipv4": {"rfc1918": "pseudo"}}, [book.custom_rule("mine", r"token\s+")])
    import tomllib

    again = Policy.from_dict(tomllib.loads(p.to_toml()))
    assert again.rows() == p.rows()
    assert len(CHECK_NAMES) == 17
    with pytest.raises(PolicyError, match=r"\[identity\]"):
        Policy({"text": {"serial-number": "hash"}})
    for bad in ({"nope": {}}, {"macs": {"oui": "hash"}}, {"verify": {"disable": ["x"]}}, {"": {"vendor": "x"}}, {"ipv4": {"pool": []}}):
        with pytest.raises(PolicyError):
            Policy(bad)


@pytest.mark.parametrize("text", ["banner motd ^\nnever closed\n", "-----BEGIN CERTIFICATE-----\nAAA\n", "}\n}\nend\n", "set\n", "\\\n", '"' * 999 + "\n", "x" * 20000 + "\n"])
def test_odd_texts_do_not_fail(text):
    for action in ("keep", "hash"):
        out(text, everything(action))
