"""One query for each single-line rule: synthesised lines under redact and under hash, by native expressions.

The counterpart builds the expected lines by concatenation alone, so it shares no pattern with the rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.rewrite import apply_rule
from umbra.plans import rulebook as book
from umbra.plans.rendering import constant, naming
from umbra.queries.base import SALT, concat, duck_tag, register, table

KEY = "c_custkey"
VALUES = {
    "v": f"concat('Zq', {KEY}, 'x')", "u": f"concat('Uw', {KEY})", "t": f"concat('Hall ', {KEY}, ' row B')", "d": f"concat('9.3(', {KEY}, ')')",
    "s": f"concat('*Zq', {KEY}, '*')", "n": f"concat('$9$Zq', {KEY})", "c": f"concat('%#%#Zq', {KEY}, '%#%#')", "m": f"concat('$6$Zq', {KEY})",
    "k": f"concat('AAAAB3NzaZq', {KEY})",
}
#: a line of each rule; names in braces are its values
LINES = {
    "enable-secret": "enable secret level 15 5 {v}", "username-secret": "username bob privilege 15 secret 9 {v}", "bare-password": " password 7 {v}",
    "bare-secret": "set system radius-server secret {v};", "authentication-password": " area 1 authentication password {v}", "encoded-key": " tunnel key 7 {v}",
    "aaa-server-key": "tacacs-server host 10.0.0.1 key {v}", "quoted-key": 'set security ike key "{v}"', "key-string": "  key-string 7 {v}",
    "key-hash": " key-hash sha256 {v}", "license-entitlement-key": "set system license keys key {v}", "snmp-community": "snmp-server community {v} RO",
    "junos-community": "    community {v} authorization", "snmp-host": "snmp-server host 10.0.0.1 version 2c {v} udp-port 162",
    "snmp-v3-auth": "snmp-server user u g v3 auth sha {v} priv", "snmp-v3-priv": "snmp-server user u g v3 priv aes 128 {v}",
    "snmp-engineid": "snmp-server engineID local {v}", "isakmp-key": "crypto isakmp key {v} address 0.0.0.0", "pre-shared-key": " pre-shared-key address 10.0.0.1 key {v}",
    "auth-key": "set protocols ntp authentication-key {v}", "message-digest-key": " ip ospf message-digest-key 1 md5 {v}",
    "bgp-neighbor-password": " neighbor 10.0.0.1 password 7 {v}", "hsrp-vrrp-auth": " standby 1 authentication md5 key-string {v}",
    "isis-password": " isis password {v} level-2", "ntp-auth-key": "ntp authentication-key 1 md5 {v} 7", "ppp-credential": " ppp chap password 0 {v}",
    "wpa-psk": " wpa-psk ascii 0 {v}", "ftp-password": "ip ftp password 7 {v}", "routeros-license-id": "# software id = {v}",
    "fortios-encrypted": "set passkey ENC {v}", "fortios-credential-key": "set ldap-password {v}", "fortios-object-name": 'set name "{v}"',
    "huawei-ont-credential": " ont add 0 1 password-auth {v} hex {u} omci ont-lineprofile-id 1", "huawei-terminal-user": " terminal user name root pw {s} 1 2024:01:02",
    "huawei-snmp-community": " snmp-agent community read cipher {v}", "huawei-snmp-usm": " snmp-agent usm-user v3 u authentication-mode sha {v}",
    "huawei-snmp-engineid": " snmp-agent local-engineid {v}", "huawei-ont-serial": ' ont add 0 1 sn-auth "{v}" omci', "huawei-ont-desc": ' ont add 0 1 omci desc "{t}"',
    "huawei-port-desc": " port desc 0/1/0 description {t}", "huawei-rack-info": "rack info 0 description {v} name {u}",
    "huawei-profile-name": ' ont-lineprofile gpon profile-id 1 profile-name "{v}"', "huawei-traffic-table-name": " traffic table ip index 5 name {v} cir 100",
    "huawei-region-name": " region-name {v}", "junos-password": 'encrypted-password "{v}";', "script-checksum": "checksum sha-256 {v}", "fortios-secret": "set psksecret ENC {v}",
    "fortios-snmp-community": 'set name "{v}"', "fortios-interface-alias": 'set alias "{v}"', "unsupported-transceiver": "service unsupported-transceiver {v} {u}",
    "hardware-model": "! model: {v}", "os-version": "version {d}", "software-image": "! system image file is {v}", "boot-image": "boot system {v}",
    "location": "snmp-server location {t}", "contact": "set snmp contact {v};", "junos-location-body": "building {v};", "description": "   description {t}",
    "acl-remark": " remark {t}", "login-message": 'set system login message "{t}"', "interface-description": " description {t}", "vlan-name": " name {v}",
    "patch-name": "   patch {v}", "pseudowire-name": "connector 1 pseudowire ldp {v} alternate {u}", "routeros-password": "add name=x password={v} wpa-password={u} mtu=1",
    "routeros-secret": "add secret={v} service=any", "routeros-pre-shared-key": 'set wpa2-pre-shared-key="{v}"', "routeros-private-key": 'add private-key="{v}"',
    "routeros-auth-key": "add auth-key={v}", "routeros-public-key": 'add public-key="{v}" port=1', "routeros-snmp-community": "add name={v} address=::/0",
    "routeros-peer-name": "add name={v}", "routeros-object-name": "add name={v}", "comment": 'add comment="{t}" chain=x', "interface-comment": 'add comment="{t}"',
    "junos-type9": 'secret "{n}"; key "{n}"', "huawei-cipher": "key {c} end", "crypt-hash": "secret {m}", "ssh-public-key": "ssh-rsa {k} user@host",
    "license-udi": "! License UDI: {t}", "serial-number": "! Serial Number: {v}",
}


def _register(rule: book.Rule) -> None:
    template, marker = LINES[rule.name], naming(rule.name, rule.family)[0]
    fixed = constant(rule.name, rule.family).replace("'", "''")
    redacted = concat(template, dict.fromkeys(VALUES, f"'{fixed}'"))
    hashed = concat(template, {k: f"'<{marker}-' || {duck_tag(marker.lower(), v)} || '>'" for k, v in VALUES.items()})

    @register(f"rule_{rule.name.replace('-', '_')}", f"SELECT {KEY}, {concat(template, VALUES)} AS line, {redacted} AS redacted, {hashed} AS hashed FROM customer")
    def run(spark, sf_dir):
        line = F.expr(concat(template, VALUES, spark=True))
        scopes = F.array(F.lit(rule.inside)) if rule.inside else F.array().cast("array<string>")
        rows = table(spark, sf_dir, "customer").select(KEY, line.alias("line"))
        return rows.select(KEY, "line", *[apply_rule(rule, action, F.col("line"), SALT, scopes).alias(name) for action, name in (("redact", "redacted"), ("hash", "hashed"))])


for _rule in book.RULES:
    _register(_rule)
