"""Scopes, blocks, banners, wrapped commands and collector captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.rewrite import apply_rule, apply_rules, rewritten
from umbra.operators import corpus, lines
from umbra.plans import rulebook as book
from umbra.plans import structure as shape
from umbra.plans.policy import Policy
from umbra.queries.base import SALT, concat, duck_tag, register, table
from umbra.queries.cases import case

K = {"k": "c_custkey"}
RULE = {r.name: r for r in book.RULES}

case("block_certificate", "crypto pki\n certificate ca 01\n  30820{k} AB\n  CD\n quit\nend\n", "crypto pki\n certificate ca 01\n  <CERT-{w}>\n quit\nend\n", {"identity": {"default": "hash"}}, K,
     {"w": duck_tag("cert", concat("30820{k} AB\n  CD", K))}, 1)
case("block_key_string", "key 1\n key-string\n  A{k}\n  B\n quit\n", "key 1\n key-string\n  <REMOVED>\n quit\n", {}, K, {}, 1)
case("block_pem_split", "-----BEGIN RSA PRIVATE KEY-----\nMII{k}\n-----END RSA PRIVATE KEY-----\n-----BEGIN CERTIFICATE-----\nMIC{k}\n-----END CERTIFICATE-----\n",
     "-----BEGIN RSA PRIVATE KEY-----\n  <REMOVED>\n-----END RSA PRIVATE KEY-----\n-----BEGIN CERTIFICATE-----\nMIC{k}\n-----END CERTIFICATE-----\n", {}, K, {}, 1)
case("block_unterminated", "-----BEGIN RSA PRIVATE KEY-----\nMII{k}\nhostname x{k}\n", "-----BEGIN RSA PRIVATE KEY-----\n  <REMOVED>\n", {}, K, {}, 1)
case("banner_multiline", "banner motd ^\nWelcome {k}\n10.0.0.1\n^\nend\n", "banner motd ^\n<REMOVED>\n^\nend\n", {"text": {"default": "redact"}}, K, {}, 1)
case("banner_inline", "  banner login # keep out {k} # tail\nend\n", "banner login #<REMOVED>#\nend\n", {"text": {"default": "redact"}}, K, {}, 1)
case("banner_kept", "banner motd ^\nsecret S{k}\n^\n", "banner motd ^\nsecret <REMOVED>\n^\n", {}, K, {}, 1)
case("join_routeros_wrap", "/interface wireless\nset [ find ] wpa2-pre-shared-key=\"Win\\\n    ter{k}\" mode=ap\n", "/interface wireless\nset [ find ] wpa2-pre-shared-key=\"<REMOVED>\" mode=ap\n", {}, K, {}, 1)
case("join_olt_wrap", " ont add 0 0 omci desc \"Shop\n{v} Ltd\" ont-srvprofile-id 1\n#\n", " ont add 0 0 omci desc <DESCRIPTION-REMOVED>\n#\n", {"interfaces": {"default": "redact"}}, {"v": "concat('B', c_custkey)"}, {}, 1)
case("collector_strip", "! Command: show version\nmodel X{k}\n! Command: show running-config\n! device: sw{k}\nhostname sw{k}\n", "hostname sw{k}\n", {}, K, {}, 0)
case("marker_roundtrip", f"! {shape.MARK} 1\nhostname sw{{k}}\n", "hostname sw{k}\n", {}, K, {}, 0)
case("scope_fortios_nesting", 'config system snmp community\n    edit 1\n        set name "C{k}"\n        config hosts\n            edit 1\n                set name "H{k}"\n            next\n        end\n    next\nend\nconfig firewall address\n    edit "a"\n        set name "A{k}"\nend\n',
     'config system snmp community\n    edit 1\n        set name "<REMOVED>"\n        config hosts\n            edit 1\n                set name "<REMOVED>"\n            next\n        end\n    next\nend\nconfig firewall address\n    edit "a"\n        set name "A{k}"\nend\n', {}, K, {}, 2)
case("scope_ownership", "interface Eth1\n description D{k}\nrouter bgp 1\n description E{k}\n", "interface Eth1\n description <DESCRIPTION-REMOVED>\nrouter bgp 1\n description E{k}\n", {"interfaces": {"default": "redact"}}, K, {}, 1)


def custom(name: str, pattern: str, given: str, expected: str, changes: int) -> None:
    from umbra.plans.rulebook import custom_rule

    @register(name, f"SELECT c_custkey, {concat(expected, K)} AS text, CAST({changes} AS BIGINT) AS changes FROM customer")
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(concat(given, K, True)).alias("text"))
        folded = corpus.sanitise(docs, Policy({}, [custom_rule("my-token", pattern)]), SALT)
        return corpus.text_of(folded.withColumn("changes", F.coalesce(F.col("counts")["my-token"], F.lit(0).cast("bigint"))), "c_custkey", "changes")


custom("rule_custom_prefix", r"\s*vault\s+token\s+", "vault token T{k} end\n", "vault token <REMOVED> end\n", 1)
custom("rule_custom_groups", r"^\s*pair\s+%VAL%\s+and\s+%VAL%", "pair A{k} and B{k}\n", "pair <REMOVED> and <REMOVED>\n", 2)


def synthetic(spark, sf_dir, template: str):
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(concat(template, K, True)).alias("text"))
    return lines.explode_lines(docs, "c_custkey")


def numbered(rows: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT c_custkey, {i} AS line_no, {concat(r, K) if '{' in r else repr(r)} AS line FROM customer" for i, r in enumerate(rows, 1))


@register("scope_ios_block", numbered(["interface Eth1", " description <DESCRIPTION-REMOVED>", "vlan 12", " name <REMOVED>", "router ospf 1", " description E{k}"]))
def scope_ios_block(spark, sf_dir):
    rows = lines.column_zero_scope(synthetic(spark, sf_dir, "interface Eth1\n description D{k}\nvlan 12\n name N{k}\nrouter ospf 1\n description E{k}\n"), "c_custkey")
    scopes = F.array_compact(F.array("ios_scope"))
    text = apply_rules((RULE["interface-description"], RULE["vlan-name"]), lambda n: "redact", F.col("line"), scopes)
    return rows.select("c_custkey", "line_no", text.alias("line"))


@register("scope_routeros_section", numbered(["/snmp community", "add name=<REMOVED>", "/ip address", "add name=B{k}", "/interface wireguard peers", "add name=<DESCRIPTION-REMOVED>"]))
def scope_routeros_section(spark, sf_dir):
    rows = lines.section_scope(synthetic(spark, sf_dir, "/snmp community\nadd name=A{k}\n/ip address\nadd name=B{k}\n/interface wireguard peers\nadd name=C{k}\n"), "c_custkey")
    text = apply_rules((RULE["routeros-snmp-community"], RULE["routeros-peer-name"]), lambda n: "redact", F.col("line"), F.col("section_scopes"))
    return rows.select("c_custkey", "line_no", text.alias("line"))


@register("scope_junos_stanza", numbered(["snmp {", "    community <REMOVED> {", "    }", "}", "policy-options {", "    community B{k} members 1:1;", "}"]))
def scope_junos_stanza(spark, sf_dir):
    text = concat("snmp {\n    community A{k} {\n    }\n}\npolicy-options {\n    community B{k} members 1:1;\n}\n", K, True)
    docs = table(spark, sf_dir, "customer").select("c_custkey", lines.lines_of(F.expr(text)).alias("lines"))
    rows = docs.select("c_custkey", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), lines.stanza_scopes(F.col("lines")).alias("scopes"))).alias("at", "x"))
    new = apply_rule(RULE["junos-community"], "redact", F.col("x.line"), SALT, F.col("x.scopes"))
    return rows.select("c_custkey", (F.col("at") + 1).alias("line_no"), new.alias("line"))


@register("scope_config_blocks", """SELECT c_custkey, line_no, scopes FROM customer, (VALUES (1, ''), (2, 'snmp-community,snmp'), (3, 'snmp-community,snmp'), (4, 'snmp-community,snmp'), (5, 'snmp-community,snmp'), (6, ''), (7, 'user-local')) t(line_no, scopes)""")
def scope_config_blocks(spark, sf_dir):
    text = concat("config system snmp community\nset name x{k}\nconfig hosts\nend\nend\nconfig user local\nedit y\n", K, True)
    docs = table(spark, sf_dir, "customer").select("c_custkey", lines.lines_of(F.expr(text)).alias("lines"))
    rows = docs.select("c_custkey", F.posexplode(lines.config_scopes(F.col("lines"))).alias("at", "scopes"))
    return rows.select("c_custkey", (F.col("at") + 1).alias("line_no"), F.array_join("scopes", ",").alias("scopes"))


@register("join_wraps_native", "SELECT c_custkey, 1 AS line_no, '/ip firewall filter' AS line FROM customer UNION ALL SELECT c_custkey, 2, concat('add chain=input comment=\"ab', c_custkey, '\" action=drop') FROM customer UNION ALL SELECT c_custkey, 4, 'print' FROM customer")
def join_wraps_native(spark, sf_dir):
    return lines.joined_wraps(synthetic(spark, sf_dir, "/ip firewall filter\nadd chain=input comment=\"a\\\n    b{k}\" action=drop\nprint\n"), "c_custkey")


@register("collector_audit", """SELECT command, sum(lines) AS lines, count(*) AS documents FROM (SELECT 'show version' AS command, 2 AS lines FROM customer UNION ALL SELECT 'collector metadata', 2 FROM customer
 UNION ALL SELECT 'collector preamble', 1 FROM customer) t GROUP BY command""")
def collector_audit(spark, sf_dir):
    text = concat("junk {k}\n! Command: show version\nmodel X{k}\n! Command: show running-config\n! device: sw{k}\nhostname sw{k}\n", K, True)
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    removed = corpus.removed_sections(corpus.sanitise(docs, Policy(), SALT), "c_custkey")
    return removed.groupBy("command").agg(F.sum("lines").cast("decimal(38,0)").alias("lines"), F.count("*").alias("documents"))


@register("idempotence_hash_redact", "SELECT c_custkey, true AS same, CAST(0 AS BIGINT) AS changes FROM customer")
def idempotence_hash_redact(spark, sf_dir):
    text = concat("hostname sw{k}\nenable secret 5 S{k}\nusername op{k} secret T{k}\ninterface Eth1\n description D{k}\n ip address 10.1.{m}.1 255.255.255.0\nbanner motd ^\nHi {k}\n^\nsnmp-server location Hall {k}\n", K | {"m": "c_custkey % 256"}, True)
    policy = Policy({"text": {"default": "hash"}, "interfaces": {"default": "redact"}, "locations": {"default": "hash"}, "policy": {"hostnames": "hash", "usernames": "redact"}, "ipv4": {"default": "hash"}})
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    once = corpus.text_of(corpus.sanitise(docs, policy, SALT), "c_custkey")
    twice = corpus.sanitise(once.withColumn("first", F.col("text")), policy, SALT)
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return corpus.text_of(twice.withColumn("changes", total), "c_custkey", "first", "changes").select("c_custkey", (F.col("text") == F.col("first")).alias("same"), "changes")


@register("native_chain_agrees", "SELECT c_custkey, true AS same FROM customer")
def native_chain_agrees(spark, sf_dir):
    """The native chain and the per-document tier give one line the same text."""
    text = concat("username op{k} privilege 15 secret 5 $1$ab{k}cd password=x{k} snmp-server community z{k} comment=\"c {k}\" AAAAB3Nza{k}", K, True)
    policy = Policy({f: {"default": "hash"} for f in ("text", "identity")})
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    rules = tuple(r for r in policy.rules() if r.family in ("secrets", "text", "identity"))
    native = rewritten(docs.withColumns({"native": F.col("text"), "scopes": F.array().cast("array<string>")}), "native", "scopes", rules, policy.rule_action, SALT)
    folded = corpus.sanitise(native.drop("scopes"), policy, SALT)
    return folded.select("c_custkey", (F.col("lines")[0] == F.col("native")).alias("same"))
