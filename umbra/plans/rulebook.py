"""The rule table and the other closed vocabularies, as data that both the native and the per-document tier compile.

Patterns are written in the dialect that Python's ``re`` and Java's regex share. Macros: ``<V>`` is a captured value,
``<E>`` a run of encoding hints, ``<REST>`` the rest of the line as a captured value. A rule's form says how it runs:

``prefix``  the pattern at column zero, then one value
``groups``  the pattern at column zero, every captured group a value
``search``  every match anywhere in the line, every captured group a value
``host``    as groups, but only the first token that is no keyword is a value
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

# ---- Fixed values: word lists, patterns and constants that results depend on -----------------------------------------

SENTINEL = r"/\*\s*(?:ACCESS-DENIED|SECRET-DATA)\s*\*/"
VALUE = rf"""(?!(?:{SENTINEL}))(?:"[^"]*"|'[^']*'|[^\s;]+)"""
ENCODING = r"(?:\d+|sha512|sha256|sha1|md5|encrypted|enc|clear|ascii|ascii-text|hex|hexadecimal|plain-text)"
NO_BRACE = r"(?![{}\s]*$)"
REST = rf"{NO_BRACE}(.+?)(?:\s*;\s*(?:##.*)?)?$"
KEY_SIGNATURE = r"AAAA(?:B3Nza|C3Nza|E2Vj)"
HOST_WORDS = ("vrf", "informs", "inform", "traps", "trap", "version", "1", "2c", "3", "auth", "noauth", "priv", "udp-port", "source-interface")
IOS_WORDS = (
    "single-connection", "source-interface", "retransmit", "acct-port", "auth-port", "udp-port", "dynamic", "informs",
    "maxpoll", "minpoll", "timeout", "version", "iburst", "inform", "prefer", "source", "burst", "traps", "port", "trap", "nat", "vrf",
)
JUNOS_WORDS = ("authentication", "hexadecimal", "ascii-text", "plain-text", "start-time", "algorithm", "sha256", "value", "sha1", "type", "key", "md5")
LOCATION_KEYS = (
    "street-address", "country-code", "postal-code", "longitude", "altitude", "building", "latitude", "npa-nxx",
    "hcoord", "vcoord", "floor", "lata", "rack", "room",
)
MODEL_KEYS = r"hardware(?:\s+(?:model|version|revision))?|model(?:\s+(?:number|name))?|chassis(?:\s+type)?|product(?:\s+id)?|platform|pid"
IMAGE_KEYS = r"software\s+image\s+version|system\s+image\s+file(?:\s+is)?|(?:software|firmware|image|junos|eos|os)\s+version"
FORTI_KEYS = r"passphrase|ppk-secret|psksecret|auth-pwd|password|priv-pwd|api-key|passwd|secret|key"
EOS_HEADER, FORTI_HEADER = r"^\s*!\s*device:\s*\S+\s*\(", r"^#config-version="
DESCRIPTION = r"\s*(?:(?:set\s+(?:\S.*?\s)?)?description|(?:set\s+)?comments?)\s+"
ROS_KEY = r"(?<![-\w])(?:[a-z\d]+-)*"


def _not_words(words: tuple[str, ...], hint: str = ENCODING, digits: bool = False) -> str:
    return rf"(?!(?:{hint}\s+)?(?:{'|'.join([*words, *([r'\d+'] if digits else [])])})(?![-\w]))"


def _any(*shapes: str) -> str:
    return "(?:" + "|".join(shapes) + ")"


#: name, family, form, pattern, scope it must be inside, scope it must be outside; in the order of application
TABLE = [
    ("enable-secret", "secrets", "prefix", r"\s*enable\s+(?:secret|password)\s+(?:level\s+\d+\s+)?<E>"),
    ("username-secret", "secrets", "prefix", r"\s*username\s+\S+\s+(?:\S+\s+)*?(?:password|secret)\s+<E>"),
    ("bare-password", "secrets", "prefix", r"\s*(?:password|passwd)\s+<E>"),
    ("bare-secret", "secrets", "prefix", r"\s*(?:set\s+\S.*?\s)?secret\s+<E>"),
    ("authentication-password", "secrets", "prefix", r".*\bauthentication\s+password\s+<E>"),
    ("encoded-key", "secrets", "prefix", r".*\bkey\s+" + _not_words(IOS_WORDS, "(?:0|7|8|encrypted)") + r"(?:0|7|8|encrypted)\s+"),
    ("aaa-server-key", "secrets", "prefix", r".*\b(?:tacacs|radius|ldap|server-private|server)\b.*?\bkey\s+" + _not_words(IOS_WORDS) + "<E>"),
    ("quoted-key", "secrets", "prefix", r'\s*(?:set\s+\S.*?\s)?key\s+(?=")'),
    ("key-string", "secrets", "prefix", r"\s*key-string\s+<E>"),
    ("key-hash", "secrets", "prefix", r"\s*(?:key-hash|hash)\s+\S+\s+"),
    ("license-entitlement-key", "secrets", "prefix", r"\s*(?:set\s+system\s+)?license\s+keys\s+key\s+"),
    ("snmp-community", "secrets", "prefix", r"\s*(?:snmp-server|set\s+snmp)\s+community\s+"),
    ("junos-community", "secrets", "prefix", r"\s*community\s+", "snmp"),
    ("snmp-host", "secrets", "host", r"^\s*snmp-server\s+host\s+\S+\s+(.*)$"),
    ("snmp-v3-auth", "secrets", "prefix", r".*\bauth\s+(?:md5|sha\d*)\s+"),
    ("snmp-v3-priv", "secrets", "prefix", r".*\bpriv\s+(?:(?:aes(?:\s+\d+)?|des|3des)\s+)?"),
    ("snmp-engineid", "identity", "prefix", r"\s*snmp-server\s+engineID\s+\S+\s+"),
    ("isakmp-key", "secrets", "prefix", r"\s*crypto\s+isakmp\s+key\s+<E>"),
    ("pre-shared-key", "secrets", "prefix", r".*\bpre-shared-key\s+(?:address\s+\S+\s+)?(?:key\s+)?<E>"),
    ("auth-key", "secrets", "prefix", r"\s*(?:set\s+\S.*?\s)?(?:authentication-key|encryption-key)\s+" + _not_words(JUNOS_WORDS, digits=True) + "<E>"),
    ("message-digest-key", "secrets", "prefix", r".*\bmessage-digest-key\s+\d+\s+md5\s+<E>"),
    ("bgp-neighbor-password", "secrets", "prefix", r".*\bneighbor\s+\S+\s+password\s+<E>"),
    ("hsrp-vrrp-auth", "secrets", "prefix", r"\s*(?:standby\s+\d+\s+|vrrp\s+\d+\s+)?authentication\s+(?:text|md5\s+key-string|md5\s+key-chain)\s+<E>"),
    ("isis-password", "secrets", "prefix", r"\s*(?:(?:lsp|area|domain)-password|isis\s+password)\s+<E>"),
    ("ntp-auth-key", "secrets", "prefix", r"\s*ntp\s+authentication-key\s+\d+\s+\S+\s+"),
    ("ppp-credential", "secrets", "prefix", r"\s*ppp\s+(?:chap|pap|eap)\s+(?:password|secret|sent-username\s+\S+\s+password)\s+<E>"),
    ("wpa-psk", "secrets", "prefix", r".*\bwpa-psk\s+<E>"),
    ("ftp-password", "secrets", "prefix", r"\s*ip\s+(?:ftp|tftp|http\s+client)\s+password\s+<E>"),
    ("routeros-license-id", "identity", "prefix", r"\s*#?\s*(?:software|system)[-\s]id\s*[:=]\s*"),
    ("fortios-encrypted", "secrets", "prefix", rf"\s*set\s+(?!(?:{FORTI_KEYS})\s)[\w-]+\s+ENC\s+"),
    ("fortios-credential-key", "secrets", "prefix", rf"\s*set\s+(?!(?:{FORTI_KEYS})\s)[\w-]*(?:password|passwd|pwd|secret|passphrase)\d*\s+(?!ENC\s)"),
    ("fortios-object-name", "text", "prefix", r"\s*set\s+name\s+", "object-labels"),
    ("huawei-ont-credential", "secrets", "groups", _any(
        r"^\s*ont\s+(?:add|confirm|modify)\s.*?\bpassword-auth\s+(\S.*?)(?:\s+hex\s+(\S.*?))?(?=\s+omci(?![-\w]))",
        r"^\s*ont\s+(?:add|confirm|modify)\s.*?\bpassword-auth\s+(\S.*?)\s*$")),
    ("huawei-terminal-user", "secrets", "groups", _any(
        r"^\s*terminal\s+user\s+name\s+\S+\s+\S+\s+(\*.*\*)(?=\s+\d+\s+\d{4}:\d{2}:)",
        r"^\s*terminal\s+user\s+name\s+\S+\s+\S+\s+(\*.*?)\s*$",
        r"^(\S*\*)(?=\s+\d+\s+\d{4}:\d{2}:\d{2}:\d{2}:\d{2}:\d{2}\s)")),
    ("huawei-snmp-community", "secrets", "groups", _any(
        r"^\s*snmp-agent\s+community\s+(?:read|write)\s+(?:(?:cipher|simple)\s+)?(\S+)",
        r"^\s*snmp-agent\s+target-host\s+.*?\bsecurityname\s+(\S+)")),
    ("huawei-snmp-usm", "secrets", "groups", r"^\s*snmp-agent\s.*?\b(?:authentication|privacy)-mode\s+(?:md5|sha\d*|sha2-\d+|aes\d*|des\d*|3des)\s+(\S+)"),
    ("huawei-snmp-engineid", "identity", "prefix", r"\s*snmp-agent\s+local-engineid\s+"),
    ("huawei-ont-serial", "identity", "groups", r"^\s*ont\s+(?:add|confirm|modify)\s.*?\bsn-auth\s+<V>"),
    ("huawei-ont-desc", "interfaces", "groups", r"^\s*ont\s+(?:add|confirm|modify)\s.*?\bdesc\s+(\S.*?)\s*$"),
    ("huawei-port-desc", "interfaces", "groups", r"^\s*(?:service-)?port\s+desc\s+\S+\s+description\s+(\S.*?)\s*$"),
    ("huawei-rack-info", "locations", "groups", r"^\s*rack\s+info\s+\d+\s+description\s+<V>(?:\s+name\s+<V>)?"),
    ("huawei-profile-name", "text", "prefix", r"\s*(?:\S+\s+)*?profile-name\s+"),
    ("huawei-traffic-table-name", "text", "prefix", r"\s*traffic\s+table\s+\S+\s+index\s+\d+\s+name\s+"),
    ("huawei-region-name", "text", "prefix", r"\s*region-name\s+"),
    ("junos-password", "secrets", "prefix", r".*\b(?:encrypted-password|plain-text-password-value)\s+"),
    ("script-checksum", "identity", "prefix", r".*\bchecksum\s+(?:md5|sha-?1|sha-?256|sha-?512)\s+"),
    ("fortios-secret", "secrets", "prefix", rf"\s*set\s+(?:{FORTI_KEYS})\s+<E>"),
    ("fortios-snmp-community", "secrets", "prefix", r"\s*set\s+name\s+", "snmp"),
    ("fortios-interface-alias", "interfaces", "prefix", r"\s*set\s+alias\s+", "interfaces"),
    ("unsupported-transceiver", "secrets", "groups", rf"^\s*service\s+unsupported-transceiver\s+{NO_BRACE}<V>(?:\s+<V>)?\s*$"),
    ("hardware-model", "platform", "groups", _any(
        rf"^\s*[!#]?\s*(?:{MODEL_KEYS})\s*[:=]\s*<REST>", rf"{EOS_HEADER}([^)]+),", rf"{FORTI_HEADER}([\w-]+?)-(?=\d+\.\d)",
        r"^\s*\[(MA\d+[A-Z]*)(?=V\d+R\d+)", r"^\s*board\s+add\s+\d+/\d+\s+(\S+)", r"^\s*!\s+\d+\s+(H\d{3}[A-Z0-9]+)(?![-\w])")),
    ("os-version", "platform", "groups", _any(
        r"^\s*(?:set\s+)?version\s+(?=\d)<REST>", rf"{EOS_HEADER}[^)]+,\s*([^\s,)]+)\s*\)\s*$", r"^\s*#.*\bby\s+RouterOS\s+<V>\s*$",
        rf"{FORTI_HEADER}.*?-(\d+\.\d[^\s:]*)", r"^\s*#(?:buildno|branch_pt)=(\S+)\s*$", r"^\s*\[.*?(V\d+R\d+[\w.]*)")),
    ("software-image", "platform", "groups", rf"^\s*!?\s*(?:(?:{IMAGE_KEYS})(?:\s*[:=]\s*|\s+)|(?:junos|eos)\s*[:=]\s*)<REST>"),
    ("boot-image", "platform", "groups", r"^\s*!?\s*boot\s+system\s+<REST>"),
    ("location", "locations", "groups", _any(
        r"^\s*(?:set\s+(?:snmp\s+)?|snmp-server\s+|snmp-agent\s+sys-info\s+)?location\s+<REST>", r".*(?<![-\w])location=<V>")),
    ("contact", "text", "groups", _any(
        r"^\s*(?:set\s+(?:snmp\s+)?|snmp-server\s+|snmp-agent\s+sys-info\s+)?contact(?:-info)?\s+<REST>", r".*(?<![-\w])contact=<V>")),
    ("junos-location-body", "locations", "groups", _any(
        rf"^\s*set\s+system\s+location\s+(?:{'|'.join(LOCATION_KEYS)})\s+<REST>", rf"^\s*(?:{'|'.join(LOCATION_KEYS)})\s+<REST>"), "location"),
    ("description", "text", "groups", rf"^{DESCRIPTION}<REST>", None, "interfaces"),
    ("acl-remark", "text", "groups", r"^\s*remark\s+<REST>"),
    ("login-message", "text", "groups", r"^\s*(?:set\s+system\s+login\s+)?(?:message|announcement)\s+<REST>"),
    ("interface-description", "interfaces", "groups", rf"^{DESCRIPTION}<REST>", "interfaces"),
    ("vlan-name", "vlans", "prefix", r"\s*(?:vlan\s+\d+\s+)?name\s+", "vlans"),
    ("patch-name", "circuits", "prefix", r"\s+patch\s+(?!panel(?![-\w]))", "patch-panel"),
    ("pseudowire-name", "circuits", "groups", _any(
        r"^\s*connector\s+\d+\s+pseudowire\s+ldp\s+<V>(?:\s+alternate\s+<V>)?\s*$", rf"^\s+pseudowire\s+{NO_BRACE}<V>\s*$")),
    ("routeros-password", "secrets", "search", ROS_KEY + "(?:password|passphrase)=<V>"),
    ("routeros-secret", "secrets", "search", ROS_KEY + "secret=<V>"),
    ("routeros-pre-shared-key", "secrets", "search", ROS_KEY + "pre-?shared-key=<V>"),
    ("routeros-private-key", "secrets", "search", ROS_KEY + "private-key=<V>"),
    ("routeros-auth-key", "secrets", "search", r"(?<![-\w])auth(?:entication)?-key=<V>"),
    ("routeros-public-key", "identity", "search", ROS_KEY + "public-key=<V>"),
    ("routeros-snmp-community", "secrets", "search", r"(?<![-\w])name=<V>", "snmp-community"),
    ("routeros-peer-name", "interfaces", "search", r"(?<![-\w])name=<V>", "wireguard-peers"),
    ("routeros-object-name", "text", "search", r"(?<![-\w])name=<V>", "object-labels", "interfaces"),
    ("comment", "text", "search", r"(?<![-\w])comment=<V>", None, "interfaces"),
    ("interface-comment", "interfaces", "search", r"(?<![-\w])comment=<V>", "interfaces"),
    ("junos-type9", "secrets", "search", r'(\$9\$[^\s";]+)'),
    ("huawei-cipher", "secrets", "search", r"(%#%#[^\s]*?%#%#)"),
    ("crypt-hash", "secrets", "search", r'(\$(?:1|2[abxy]?|5|6|y)\$[^\s";]+)'),
    ("ssh-public-key", "identity", "search", _any(
        r"(?:\b(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-[\w-]+)\s+|\bssh-known-hosts\s+host\s+\S+\s+(?:rsa|dsa|ecdsa|ed25519)-key\s+)"
        r'("?AAAA[0-9A-Za-z+/=]+"?)', rf'("?{KEY_SIGNATURE}[0-9A-Za-z+/=]*"?)')),
    ("license-udi", "identity", "search", r"^\s*!?\s*(?>License\s+UDI:?\s*)(.+)$"),
    ("serial-number", "identity", "search", r"^\s*[!#]?\s*(?:set\s+)?(?:System\s+)?[Ss]erial[-\s]*(?:[Nn]umber)?\s*[:=]?\s+(\S+.*)$"),
]
CASE_SENSITIVE = ("junos-type9", "huawei-cipher", "crypt-hash", "ssh-public-key", "serial-number")
BANNER = ("banner", "text", r"^\s*banner\s+([\w-]+)\s+(.*)$")
#: name, family, opening line, closing line, whether case matters
BLOCKS = [
    ("certificate-block", "identity", r"^\s*certificate\s+(?:self-signed|ca)?\s*\S*\s*(?:nvram:\S+)?\s*$", r"^\s*quit\s*$", False),
    ("key-string-block", "secrets", r"^\s*key-string\s*$", r"^\s*quit\s*$", False),
    ("pem-key", "secrets", r"-----BEGIN [A-Z0-9 ]*(?:KEY|PARAMETERS)-----", r"-----END [A-Z0-9 ]*(?:KEY|PARAMETERS)-----", True),
    ("pem-cert", "identity", r"-----BEGIN [A-Z0-9 ]*CERTIFICATE-----", r"-----END [A-Z0-9 ]*CERTIFICATE-----", True),
]
#: rule: vendor
RULE_VENDORS = {
    "junos-community": "juniper", "routeros-license-id": "mikrotik", "fortios-encrypted": "fortinet",
    "fortios-credential-key": "fortinet", "fortios-object-name": "fortinet", "huawei-ont-credential": "huawei",
    "huawei-terminal-user": "huawei", "huawei-snmp-community": "huawei", "huawei-snmp-usm": "huawei",
    "huawei-snmp-engineid": "huawei", "huawei-ont-serial": "huawei", "huawei-ont-desc": "huawei",
    "huawei-port-desc": "huawei", "huawei-rack-info": "huawei", "huawei-profile-name": "huawei",
    "huawei-traffic-table-name": "huawei", "huawei-region-name": "huawei", "junos-password": "juniper",
    "fortios-secret": "fortinet", "fortios-snmp-community": "fortinet", "fortios-interface-alias": "fortinet",
    "unsupported-transceiver": "arista", "junos-location-body": "juniper", "patch-name": "arista",
    "pseudowire-name": "arista", "routeros-password": "mikrotik", "routeros-secret": "mikrotik",
    "routeros-pre-shared-key": "mikrotik", "routeros-private-key": "mikrotik", "routeros-auth-key": "mikrotik",
    "routeros-public-key": "mikrotik", "routeros-snmp-community": "mikrotik", "routeros-peer-name": "mikrotik",
    "routeros-object-name": "mikrotik", "comment": "mikrotik", "interface-comment": "mikrotik",
    "junos-type9": "juniper", "huawei-cipher": "huawei",
}

IPV4 = r"(?<![\w.])((?:\d{1,3}\.){3}\d{1,3})(?![\w.])"
_H = "[0-9A-Fa-f]"
IPV6 = (
    rf"(?<![\w:.])("
    rf"(?:{_H}{{1,4}}:){{7}}{_H}{{1,4}}"
    rf"|(?:{_H}{{1,4}}:){{1,7}}:"
    rf"|(?:{_H}{{1,4}}:){{1,6}}:{_H}{{1,4}}"
    rf"|(?:{_H}{{1,4}}:){{1,5}}(?::{_H}{{1,4}}){{1,2}}"
    rf"|(?:{_H}{{1,4}}:){{1,4}}(?::{_H}{{1,4}}){{1,3}}"
    rf"|(?:{_H}{{1,4}}:){{1,3}}(?::{_H}{{1,4}}){{1,4}}"
    rf"|(?:{_H}{{1,4}}:){{1,2}}(?::{_H}{{1,4}}){{1,5}}"
    rf"|{_H}{{1,4}}:(?::{_H}{{1,4}}){{1,6}}"
    rf"|:(?:(?::{_H}{{1,4}}){{1,7}}|:))"
    r"(?![\w:.])"
)
MAC = rf"(?<![\w.:-])({_H}{{4}}\.{_H}{{4}}\.{_H}{{4}}|{_H}{{4}}(?:-{_H}{{4}}){{2}}|(?:{_H}{{2}}:){{5}}{_H}{{2}}|(?:{_H}{{2}}-){{5}}{_H}{{2}})(?![\w.:-])"
BARE_MAC = rf"(\b(?:mac-address|mac\s+address|hardware-address)\s+)({_H}{{12}})(?!{_H})"
EMAIL = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
#: the same in file names and titles, where _ and - separate words
LABEL_IPV4 = r"(?<![A-Za-z0-9.])((?:\d{1,3}\.){3}\d{1,3})(?!(?:[A-Za-z0-9]|\.\d))"
LABEL_IPV6 = IPV6.replace(r"(?<![\w:.])", r"(?<![A-Za-z0-9:.])").replace(r"(?![\w:.])", r"(?![A-Za-z0-9:.])")
LABEL_MAC = MAC.replace(r"(?<![\w.:-])", r"(?<![A-Za-z0-9:-])").replace(r"(?![\w.:-])", r"(?![A-Za-z0-9:-])")
LABEL_BEFORE_EMAIL, LABEL_AFTER_EMAIL = r"(?<![\w.!#$%&'*+/=?^_`{|}~-])", r"(?![\w.-])"

#: family, pattern; a value's surrounding quotes and semicolons are dropped, a domain list is split at commas and spaces
COLLECTORS = [
    ("hostnames", r"^\s*(?:set\s+)?(?:hostname|switchname|sysname)\s+(\S+)"),
    ("hostnames", r"^\s*(?:set\s+system\s+)?host-name\s+(\S+?);?\s*$"),
    ("hostnames", r"^\s*!\s*device:\s*(\S+)"),
    ("domains", r"^\s*ip\s+domain[-\s]name\s+(?:vrf\s+\S+\s+)?(\S+)"),
    ("domains", r"^\s*(?:set\s+system\s+)?domain-name\s+(\S+?);?\s*$"),
    ("domains", r"^\s*dns\s+domain\s+(\S+)"),
    ("domains", r"^\s*(?:set\s+system\s+)?domain-search\s+\[?\s*([^\];]+)"),
    ("usernames", r"^\s*username\s+(\S+)"),
    ("usernames", r"^\s*set\s+system\s+login\s+user\s+(\S+)"),
    ("usernames", r"^\s*user\s+(\S+)\s*\{"),
    ("usernames", r"^\s*snmp-server\s+user\s+(\S+)"),
    ("usernames", r"^\s*!\s*Last configuration change.*?\bby\s+(\S+)"),
    ("usernames", r"^\s*##\s*Last changed:.*?\bby\s+(\S+)"),
    ("usernames", r"^#config-version=.*[:\s]user=(\S+)"),
    ("usernames", r"^\s*terminal\s+user\s+name\s+[\w-]*password\s+(\S+)"),
    ("usernames", r"^\s*ssh\s+user\s+(\S+)"),
]
#: family, scopes of which one must hold, pattern
SCOPED_COLLECTORS = [
    ("usernames", ("system-admin",), r'^\s*edit\s+"([^"]+)"\s*$'),
    ("usernames", ("system-api-user",), r'^\s*edit\s+"([^"]+)"\s*$'),
    ("usernames", ("user-local",), r'^\s*edit\s+"([^"]+)"\s*$'),
    ("usernames", ("snmp-user",), r'^\s*edit\s+"([^"]+)"\s*$'),
    ("hostnames", ("system-global",), r"^\s*set\s+alias\s+(\S+)"),
]
SECTION_COLLECTORS = [
    ("hostnames", ("system-identity",), r'(?<![-\w])name=("[^"]*"|\S+)'),
    ("usernames", ("user", "ppp-secret"), r'(?<![-\w])name=("[^"]*"|\S+)'),
]

IOS_SCOPES = [("interfaces", r"^interface\s+\S"), ("vlans", r"^vlan\s+(?:\d|database\b)"), ("patch-panel", r"^patch\s+panel\b")]
SET_SCOPE = r"\s*set\s+([\w-]+)\b"
SET_LOCATION = r"\s*set\s+system\s+location\b"
STANZA_OPEN, STANZA_CLOSE = r"^\s*([\w-]+)[^{}]*\{\s*$", r"^\s*\}\s*$"
SECTION = r"^/([a-z][\w-]*(?:\s+[a-z][\w-]*)*)"
SECTION_SCOPES = [
    (("wireguard-peers", "object-labels", "interfaces"), r"interface\s+wireguard\s+peers(?![\w-])"),
    (("bgp-connections", "object-labels"), r"routing\s+bgp\s+connection(?![\w-])"),
    (("routing-filter-rules",), r"routing\s+filter\s+rule(?![\w-])"),
    (("snmp-community", "snmp"), r"snmp\s+community(?![\w-])"),
    (("system-identity",), r"system\s+identity(?![\w-])"),
    (("ppp-secret",), r"ppp\s+secret(?![\w-])"),
    (("interfaces",), r"interface(?![\w-])"),
    (("snmp",), r"snmp(?![\w-])"),
    (("user",), r"user(?![\w-])"),
]
CONFIG_OPEN, CONFIG_END = r"^\s*config\s+(\S.*?)\s*$", r"^\s*end\s*$"
CONFIG_SCOPES = [
    (("snmp-user",), r"system\s+snmp\s+user"),
    (("snmp-community", "snmp"), r"system\s+snmp\s+community"),
    (("snmp",), r"system\s+snmp(?:\s+\S+)?"),
    (("interfaces", "fortios-interface-names"), r"system\s+interface"),
    (("fortios-interface-names",), r"system\s+(?:zone|switch-interface|virtual-switch)"),
    (("fortios-route-device",), r"router\s+static6?"),
    (("object-labels",), r"firewall\s+policy"),
    (("system-global",), r"system\s+global"),
    (("system-admin",), r"system\s+admin"),
    (("system-api-user",), r"system\s+api-user"),
    (("user-local",), r"user\s+local"),
]

V4_CLASSES = [
    ("loopback", ("127.0.0.0/8",)), ("rfc1918", ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")), ("cgnat", ("100.64.0.0/10",)),
    ("link_local", ("169.254.0.0/16",)), ("multicast", ("224.0.0.0/4",)), ("documentation", ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")),
    ("benchmark", ("198.18.0.0/15",)), ("reserved", ("0.0.0.0/8", "192.0.0.0/24", "192.88.99.0/24", "240.0.0.0/4", "255.255.255.255/32")),
]
V6_CLASSES = [
    ("unspecified", ("::/128",)), ("loopback", ("::1/128",)), ("ula", ("fc00::/7",)), ("link_local", ("fe80::/10",)), ("multicast", ("ff00::/8",)),
    ("documentation", ("2001:db8::/32",)), ("teredo", ("2001::/32",)), ("six_to_four", ("2002::/16",)), ("ipv4_mapped", ("::ffff:0:0/96", "64:ff9b::/96")),
]
V4_NAMES = (*[n for n, _ in V4_CLASSES], "well_known", "other_unicast")
V6_NAMES = (*[n for n, _ in V6_CLASSES], "well_known", "other_unicast")
V4_RESOLVERS = ("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220", "4.2.2.1", "4.2.2.2")
V6_RESOLVERS = ("2001:4860:4860::8888", "2001:4860:4860::8844", "2606:4700:4700::1111", "2606:4700:4700::1001")
V4_POOLS, V6_POOL, MAC_POOL = ("198.18.0.0/15", "100.64.0.0/10"), "2001:db8::/32", "00:00:5e"

ACTIONS = ("keep", "pseudo", "hash", "redact")
RULE_FAMILIES = ("secrets", "text", "locations", "identity", "platform", "interfaces", "vlans", "circuits")
NAME_FAMILIES = ("hostnames", "domains", "usernames", "emails")
FAMILIES = (*RULE_FAMILIES, *NAME_FAMILIES, "ipv4", "ipv6", "macs")

#: key: (marker, token); a key is a rule, else a family
RENDERINGS = {
    "secrets": ("SECRET", None), "text": ("DESC", "desc"), "locations": ("DESC", "desc"), "interfaces": ("DESC", "desc"), "vlans": ("VLAN", "vlname"),
    "circuits": ("CIRCUIT", "circuit"), "serial-number": ("SERIAL", "SN"), "license-udi": ("UDI", "udi"), "snmp-engineid": ("EID", "eid"),
    "ssh-public-key": ("KEY", "key"), "routeros-public-key": ("KEY", "key"), "certificate-block": ("CERT", "cert"), "pem-cert": ("CERT", "cert"),
    "script-checksum": ("CKSUM", "cksum"), "routeros-license-id": ("LICID", "licid"), "hardware-model": ("MODEL", "model"), "os-version": ("VERSION", "ver"),
    "software-image": ("IMAGE", "image"), "boot-image": ("IMAGE", "image"), "hostnames": ("HOST", None), "domains": ("DOMAIN", None),
    "usernames": ("USER", None), "emails": ("EMAIL", None), "ipv4": ("IP", None), "ipv6": ("IP6", None), "macs": ("MAC", None),
}
FALLBACK = {"identity": ("ID", "id"), "platform": ("PLATFORM", "platform")}
REMOVED, TEXT_REMOVED = "<REMOVED>", "<DESCRIPTION-REMOVED>"
CONSTANTS = {
    "ipv4": "192.0.2.0", "ipv6": "2001:db8::", "hostnames": "redacted", "domains": "example.invalid", "usernames": "user", "emails": "user@example.invalid",
    "text": TEXT_REMOVED, "locations": TEXT_REMOVED, "interfaces": TEXT_REMOVED, "banner": REMOVED,
}
OWN_NAMES = {
    "hostnames": r"device-[0-9a-f]{1,6}", "usernames": r"user-[0-9a-f]{1,4}", "domains": r"(?:d[0-9a-f]{1,4}\.example\.com|example\.(?:com|net|org))",
    "emails": r"user-[0-9a-f]{1,4}@(?:d[0-9a-f]{1,4}\.example\.com|example\.(?:com|net|org))",
}
FIRST_DOMAINS = ("example.com", "example.net", "example.org")

#: kind: (marker, token)
OPERATIONAL = {
    "acl-firewall-filter": ("ACL", "acl"), "route-map": ("ROUTE-MAP", "route-map"), "prefix-list": ("PREFIX-LIST", "prefix-list"),
    "policy-statement": ("POLICY", "policy"), "vrf": ("VRF", "vrf"), "peer-group": ("PEER-GROUP", "peer-group"),
    "label-switched-path": ("LSP", "lsp"), "configuration-group": ("CONFIG-GROUP", "config-group"),
    "routing-filter-chain": ("FILTER-CHAIN", "filter-chain"), "fortios-interface": ("FOS-IF", "fos-if"),
}
RESERVED_VRFS = ("default", "global", "none")
FACTORY_INTERFACES = r"any|port\d+|wan\d*|internal\d*|dmz\d*|mgmt\d*|ha\d*|lan\d*|modem|fortilink|virtual-wan-link|npu\d*_vlink\d*|vsys_\w+|(?:ssl|l2t|naf)\.\w+"
INTERFACE_REFS = r"srcintf|dstintf|interface|extintf|associated-interface|outgoing-interface|src-interface|dst-interface"
#: (kind, how, pattern, scope), in order. how: one (group 2 is a name), each (every token of group 2), term (group 2 under
#: the open parent), named (group 4 under group 2), block (group 2, directly in a groups block), peer (group 2, not an address)
OPERATIONAL_STEPS = [
    ("routing-filter-chain", "one", r"((?<![-\w])chain=)([^\s;]+)", "routing-filter-rules"),
    ("routing-filter-chain", "one", r"((?:(?:input|output)\.|(?<![-\w])\.)(?:filter|filter-chain)=)([^\s;]+)"),
    ("fortios-interface", "each", r'^(\s*edit\s+)("[^"]*"|\S+)(\s*)$', "fortios-interface-names"),
    ("fortios-interface", "each", r"^(\s*set\s+member\s+)(.*?)(\s*)$", "fortios-interface-names"),
    ("fortios-interface", "each", r"^(\s*set\s+device\s+)(.*?)(\s*)$", "fortios-route-device"),
    ("fortios-interface", "each", rf"^(\s*set\s+(?:{INTERFACE_REFS})\s+)(.*?)(\s*)$"),
    ("", "term", r"^(\s*term\s+)(\S+)(?=\s*\{)"),
    ("acl-firewall-filter", "one", r"(\b(?:ip|ipv6|mac)\s+access-list\s+(?:(?:standard|extended)\s+)?)(\S+)"),
    ("acl-firewall-filter", "one", r"(\b(?:ip\s+)?access-group\s+)(\S+)"),
    ("acl-firewall-filter", "one", r"(\b(?:traffic-filter|access-class)\s+)(\S+)"),
    ("acl-firewall-filter", "one", r"(\bfirewall\s+family\s+\S+\s+filter\s+)(\S+)"),
    ("acl-firewall-filter", "one", r"(\bfilter\s+(?:input|output)\s+)(\S+)"),
    ("acl-firewall-filter", "one", r"(\bfilter\s+)(\S+)(?=\s*\{)"),
    ("acl-firewall-filter", "named", r"(\bfirewall\s+family\s+\S+\s+filter\s+)(\S+)(\s+term\s+)(\S+)"),
    ("route-map", "one", r"(\broute-map\s+)(\S+)"),
    ("prefix-list", "one", r"(\b(?:ip|ipv6)\s+prefix-list\s+)(\S+)"),
    ("prefix-list", "one", r"(\b(?:match\s+(?:ip|ipv6)\s+address\s+|neighbor\s+\S+\s+)prefix-list\s+)(\S+)"),
    ("prefix-list", "one", r"(\bpolicy-options\s+prefix-list\s+)(\S+)"),
    ("prefix-list", "one", r"(\bprefix-list(?:-filter)?\s+)(\S+)"),
    ("policy-statement", "one", r"(\bpolicy-statement\s+)(\S+)"),
    ("policy-statement", "named", r"(\bpolicy-statement\s+)(\S+)(\s+term\s+)(\S+)"),
    ("policy-statement", "one", r"((?<![\w-])(?:import|export|vrf-import|vrf-export)\s+)(?!\[)(\S+)"),
    ("policy-statement", "each", r"((?<![\w-])(?:import|export|vrf-import|vrf-export)\s+\[)([^\]]+)(\])"),
    ("vrf", "one", r"(\bvrf\s+(?:(?:instance|definition|forwarding|member)\s+)?)(\S+)"),
    ("vrf", "one", r"(\bip\s+vrf\s+)(\S+)"),
    ("vrf", "one", r"(\brouting-instances?\s+)(\S+)"),
    ("vrf", "one", r"((?<![\w-])vpn-instance\s+)(\S+)"),
    ("label-switched-path", "one", r"(\blabel-switched-path\s+)([^\s{};]+)"),
    ("label-switched-path", "one", r"((?<![\w-])lsp-next-hop\s+)([^\s{};]+)"),
    ("configuration-group", "block", r"^(\s*)([^\s{};]+)(?=\s*\{)"),
    ("configuration-group", "one", r"^(\s*(?:(?:set|delete|deactivate|activate)\s+)?groups\s+)([^\s{};]+)"),
    ("configuration-group", "one", r"((?<![\w-])apply-groups(?:-except)?\s+)(?!\[)([^\s{};]+)"),
    ("configuration-group", "each", r"((?<![\w-])apply-groups(?:-except)?\s+\[)([^\]]+)(\])"),
    ("peer-group", "one", r"(\bneighbor\s+)([^\s]+)(?=\s+peer\s+group\s*$)"),
    ("peer-group", "one", r"(\bneighbor\s+\S+\s+peer\s+group\s+)(\S+)"),
    ("peer-group", "one", r"(\bneighbor\s+\S+\s+peer-group\s+)(\S+)"),
    ("peer-group", "one", r"(\bprotocols\s+bgp\s+group\s+)(\S+)"),
    ("peer-group", "peer", r"(\bneighbor\s+)(\S+)(?!\S)(?!\s+peer\s+group\s+\S+)"),
]
TERM_PARENTS = [("policy-statement", r"^.*?\bpolicy-statement\s+(\S+)\s*\{"), ("acl-firewall-filter", r"^\s*filter\s+(\S+)\s*\{")]
GROUPS_OPEN = r"^\s*groups\s*\{"

ASN_ONE = [r"(\b(?:router\s+bgp|remote-as|local-as|autonomous-system)\s+)(\d+(?:\.\d+)?)\b", r"((?:^|[\s.])(?:(?:local|remote)[-.])?as=)(\d+(?:\.\d+)?)(?![\w.])"]
ASN_PATH, ASN = r"(\bas-path\s+prepend\s+)([\d. ]+)", r"\d+(?:\.\d+)?"
#: first, last, name of the numbers that stand in for each other; and numbers that always stay
ASN_SPACES = [(64512, 65534, "asn-private16"), (4200000000, 4294967294, "asn-private32"), (1, 64495, "asn-public16"), (65552, 4199999999, "asn-public32")]
ASN_STAY = [(0, 0), (23456, 23456), (65535, 65535), (4294967295, 4294967295), (64496, 64511), (65536, 65551)]
ASN_QUIET = ("0", "23456", "65535", "4294967295")

COLLECTOR_HEADER, COMMAND_HEADER, DEVICE_HEADER = r"^\s*[#!;]\s*RANCID-CONTENT-TYPE\s*:", r"^\s*!\s*Command\s*:\s*(.+?)\s*$", r"^\s*!\s*device\s*:"
PROMPT = r"^\s*(?:[#!;]\s*)?([A-Za-z0-9_.%+:-]+)@(\S+)([>#])[ \t]+(.+?)[ \t]*$"
HOST_PROMPT = r"^\s*[#!;]\s*([A-Za-z0-9_.-]+)(?:\s+\([\w.-]+\))?\s+#[ \t]+(\S.*?)[ \t]*$"
CONFIG_COMMANDS = ("show configuration", "show configuration | display set", "show running-config", "show startup-config", "show full-configuration", "show")

ROS_WRAP = r"^(?:/[a-z][\w-]*(?:\s+[a-z][\w-]*)*\s+)?(?:add|set|remove)\s+\S.*\\$"
OLT_WRAP = r"^\s+(?:ont(?:-(?:line|srv)profile)?|terminal|service-port|traffic|dba-profile|vlan)\s"
OLT_STRUCTURE = r"[\[#!<]|return\s*$"

#: vendor: (pattern, weight); a hint counts once a document, ties go to the earlier vendor
DECISIVE, STRONG, WEAK = 50, 8, 2
VENDOR_HINTS = {
    "juniper": (
        (r"^\s*##\s*Last changed:", DECISIVE), (r"\$9\$", DECISIVE), (r"\b\d+\.\d+[RX]\d", DECISIVE),
        (r"^set\s+(?:system|interfaces|protocols|routing-options|security)\s", STRONG),
        (r"^\s*(?:system|interfaces|protocols|routing-instances|policy-options)\s*\{", STRONG),
        (r"\bj(?:install|unos)-\S+", STRONG), (r"apply-groups", WEAK), (r"^\s*unit\s+\d+\s*\{", WEAK)),
    "arista": (
        (r"^\s*!\s*device:.*\bEOS", DECISIVE), (r"\bEOS(?:64)?-\d", DECISIVE), (r"\.swi\b", DECISIVE), (r"^\s*!\s*device:\s*\S", STRONG),
        (r"^\s*!\s*Command:\s*show\s", STRONG), (r"^\s*management\s+api\s+http-commands", STRONG), (r"^\s*service\s+routing\s+protocols\s+model", STRONG),
        (r"^\s*switchname\s+\S+", STRONG), (r"^\s*daemon\s+TerminAttr\b", STRONG), (r"secret\s+sha512", WEAK), (r"^\s*no\s+aaa\s+root", WEAK)),
    "mikrotik": (
        (r"\bby\s+RouterOS\b", DECISIVE), (r"^#\s*software\s+id\s*=", DECISIVE), (r"^/(?:interface|ip|system|snmp|user|routing)\b", STRONG),
        (r"set\s+\[\s*find\b", STRONG), (r"^add\s+\S+=", WEAK), (r"^#\s*model\s*=", WEAK)),
    "fortinet": (
        (r"^#config-version=", DECISIVE), (r"\bENC\s+[A-Za-z0-9+/=]{12,}", DECISIVE), (r"^#(?:conf_file_ver|buildno|global_vdom|branch_pt)=", STRONG),
        (r"^config\s+system\s+\S", STRONG), (r"^config\s+(?:firewall|vpn|user|router|log|wireless-controller)\s+\S", STRONG),
        (r"^\s*edit\s+\"", STRONG), (r"^\s*next\s*$", STRONG), (r"^\s*set\s+vdom\b", STRONG), (r"^\s*unset\s+\S", WEAK)),
    "huawei": (
        (r"^\s*ont\s+(?:add|confirm|modify)\s+\d+\s+\d+\s+", DECISIVE), (r"^\s*service-port\s+\d+\s+vlan\s+\d+\s+gpon\s+", DECISIVE),
        (r"\bMA5[68]\d\d(?!\d)", DECISIVE), (r"^\[(?:global|public|vlan|device|platform|sysmode)-config\]\s*$", STRONG),
        (r"^\s*<(?:global|public|vlan|device|platform|sysmode)-config>\s*$", STRONG), (r"^\s*ont-(?:line|srv)profile\s+gpon\b", STRONG),
        (r"^\s*interface\s+gpon\s+\d+/\d+", STRONG), (r"^\s*terminal\s+user\s+name\s+", STRONG),
        (r"^\s*snmp-agent\s+(?:local-engineid|community|sys-info|usm-user)\b", STRONG), (r"^\s*sysman\s+(?:ip-access|vpn-instance)\b", STRONG),
        (r"^\s*traffic\s+table\s+\S+\s+index\s+\d+\b", STRONG), (r"^\s*vlan\s+\d+(?:\s+to\s+\d+)?\s+smart\b", STRONG), (r"^\s*sysname\s+\S", WEAK),
        (r"^\s*(?:gem\s+(?:add|mapping)|tcont)\s+\d", WEAK), (r"^\s*dba-profile\s+add\s+profile-id\b", WEAK)),
    "cisco": (
        (r"^\s*boot-start-marker", DECISIVE), (r"^\s*Building\s+configuration", DECISIVE), (r"^\s*Current\s+configuration\s*:", DECISIVE),
        (r"^\s*ip\s+cef\b", STRONG), (r"^\s*crypto\s+pki\s+", STRONG), (r"^\s*!\s*Last\s+configuration\s+change", STRONG),
        (r"^\s*version\s+\d+\.\d+\(\d", STRONG), (r"^\s*service\s+timestamps", WEAK), (r"^\s*line\s+con\s+0", WEAK), (r"^\s*feature\s+\S+", WEAK)),
}

_HINT = ENCODING[:-1] + r"|type|value|key|level\s+\d+)"
_CREDENTIAL = (
    r"password|passwd|passphrase|secret|pre-?shared-key|private-key|key-string|auth(?:entication)?-key|encrypted-password|wpa-psk|"
    r"psksecret|ppk-secret|privatekey|api-key|[\w-]*pwd"
)
MARKERS = "|".join(sorted({m for m, _ in RENDERINGS.values()}))
#: check, pattern, whether values of kept rules are blanked first
CHECKS = [
    ("crypt-hash-left", r"\$(?:1|2[abxy]?|5|6|y)\$", False),
    ("junos-type9-left", r"\$9\$", False),
    ("ssh-key-left", rf"{KEY_SIGNATURE}|ssh-(?:rsa|dss|ed25519)\s+[A-Za-z0-9+/]{{20,}}", True),
    ("pem-left", r"-----BEGIN(?![A-Z0-9 ]*CERTIFICATE-----)", True),
    ("type7-left", r"(?i)\b(?:password|key)\s+7\s+[0-9A-Fa-f]{6,}", False),
    ("huawei-cipher-left", r"(?im)%#%#|\$1a\$|^\s*terminal\s+user\s+name\s+\S+\s+\S+\s+\*|\*\s+\d+\s+\d{4}:\d{2}:", False),
    ("long-hex-left", r"(?<![\w.])[0-9A-Fa-f]{24,}(?![\w.])", True),
    ("long-base64-left", r"(?<![\w+/=])[A-Za-z0-9+/]{40,}={0,2}(?![\w+/=])", True),
    ("credential-left", rf"(?im)(?:\b(?:{_CREDENTIAL})\b|(?:^\s*|\bsnmp(?:-server)?\s+)community\b|^\s*set\s+(?:key|secret)(?![-\w])|^\s*set\s+[\w-]+\s+ENC\b)"
     rf"(?!(?:-[\w-]+)?\s*=?\s*(?:{_HINT}\s*)*(?:$|[;{{]|\"?<|\"?-----BEGIN\b|\"\"|''))", False),
]
MORE_CHECKS = ("email-left", "ipv4-left", "ipv6-left", "mac-left", "operational-name-left", "as-number-left", "location-left", "routeros-header-left")
CERTIFICATE, BLOCK_END = r"-----BEGIN [A-Z0-9 ]*CERTIFICATE-----", r"-----END"
HANDLED = r'\s*"?(?:' + "|".join([rf"<(?:{MARKERS})-[0-9a-f]{{6}}>", *[re.escape(c) for c in sorted({REMOVED, *CONSTANTS.values()})]]) + r')"?\s*'
SCOPED_COMMUNITY, COMMUNITY_HANDLED = r'(?:^\s*set\s+name\s+|(?<![-\w])name=)("[^"]*"|\S+)', r"""(?:"?<[^\s<>]*>"?\s*;?|""|'')"""
HEADER_LEFT = r"^#\s*([a-z][a-z ]{0,22}[a-z])\s*=\s*(\S.*?)\s*$"
BLIND_FAMILIES = ("identity", "text", "locations", "interfaces", "vlans", "circuits")
IGNORED = [
    r"\buser-[0-9a-f]{4}@(?:example|d[0-9a-f]{4}\.example)\.\w+", SENTINEL, r"\b(?:no|service)\s+password\b", r"password-(?:policy|encryption|expire\w*)",
    r"\bpassword\s+encryption\b", r"\bkey[-\s]chain\b", r"\bsecret-?data\b", r"\b(?:set|match|add|delete)\s+community\b", r"\bcommunity-list\b",
    r"\bcommunity\s+[\w:.-]+\s+members\b", r"\bcommunity\s+\d+:\d+", r"\bcommunity\s+(?:additive|no-export|no-advertise|internet|local-as)\b",
    r"\bauthentication-types=[\w,-]+", r"^/[a-z][\w-]*(?:\s+(?!(?:add|set|remove|print|get|find)\b)[a-z][\w-]*)*", r"^\s*config\s+\S.*$",
    rf"(?<=<)(?:{MARKERS})-[0-9a-f]{{6}}>",
]
# ---- end of the fixed values -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    name: str
    family: str
    form: str
    pattern: str
    inside: str | None = None
    outside: str | None = None
    custom: bool = False
    action: str | None = None

    @cached_property
    def expanded(self) -> str:
        """The full pattern: prefix rules as (what stands before)(value)(what follows), others with every group a value."""
        p = self.pattern.replace("<E>", rf"(?:{ENCODING}\s+)*").replace("<REST>", REST).replace("<V>", f"({VALUE})").replace("%VAL%", f"({VALUE})")
        return rf"^({p}){NO_BRACE}({VALUE})(.*)$" if self.form == "prefix" else p

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.expanded, 0 if self.name in CASE_SENSITIVE else re.I)

    @cached_property
    def targets(self) -> tuple[int, ...]:
        return (2,) if self.form == "prefix" else tuple(range(1, self.regex.groups + 1))

    @property
    def vendor(self) -> str | None:
        return RULE_VENDORS.get(self.name)


def custom_rule(name: str, pattern: str, family: str = "secrets", action: str | None = None, stanza: str | None = None) -> Rule:
    """A rule of the caller's own: without groups a prefix, with groups (or %VAL%) each group a value."""
    try:
        grouped = re.compile(pattern.replace("%VAL%", "()")).groups > 0
        rule = Rule(name, family, "groups" if grouped else "prefix", pattern, stanza, custom=True, action=action)
        rule.regex  # noqa: B018
    except (re.error, OverflowError) as e:
        raise ValueError(f"custom rule {name!r}: bad pattern: {e}") from e
    return rule


RULES = tuple(Rule(*row) for row in TABLE)
RULE_FAMILY = {r.name: r.family for r in RULES} | {BANNER[0]: BANNER[1]} | {b[0]: b[1] for b in BLOCKS}


def rule_order(custom: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """Column-zero rules, then the caller's own, then searched ones."""
    return (*[r for r in RULES if r.form != "search"], *custom, *[r for r in RULES if r.form == "search"])
