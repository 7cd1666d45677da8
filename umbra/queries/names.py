"""Learned names, operational names, labels: whole documents against text built by concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.operators import corpus, identities, reports
from umbra.plans.policy import Policy
from umbra.queries.addresses import duck_mod
from umbra.queries.base import SALT, concat, duck_hmac, duck_tag, register, table
from umbra.queries.cases import case

NAMES = {"v": "concat('core-rtr-', c_custkey)", "n": "concat('netop', c_custkey)", "d": "concat('corp', c_custkey, '.example.org')"}
DEVICE = f"concat('device-', {duck_tag('hostname', concat('core-rtr-{k}#0', {'k': 'c_custkey'}))})"
USER = f"concat('<USER-', {duck_tag('user', NAMES['n'])}, '>')"

case("hostname_pseudo", "hostname {v}\nntp server {v}\n! see CORE-RTR-{k} and x-{v}\n", "hostname {w}\nntp server {w}\n! see {w} and x-{v}\n", {"policy": {"hostnames": "pseudo"}}, NAMES | {"k": "c_custkey"}, {"w": DEVICE}, 3)
case("username_hash", "username {n} privilege 1\n logged in as {n}\n", "username {w} privilege 1\n logged in as {w}\n", {"policy": {"usernames": "hash"}}, NAMES, {"w": USER}, 2)
case("domain_first_three", "ip domain-name a{k}.test\ndns domain b{k}.test\ndomain-search [ c{k}.test d{k}.test ]\n",
     "ip domain-name example.com\ndns domain example.net\ndomain-search [ example.org {w} ]\n", {"policy": {"domains": "pseudo"}}, {"k": "c_custkey"},
     {"w": f"concat('d', {duck_tag('domain', concat('d{k}.test#0', {'k': 'c_custkey'}), 4)}, '.example.com')"}, 4)
case("name_longest_first", "hostname {v}.{d}\nip domain-name {d}\nlog {v}.{d} at {d}\n", "hostname redacted\nip domain-name example.invalid\nlog redacted at example.invalid\n",
     {"policy": {"hostnames": "redact", "domains": "redact"}}, NAMES, {}, 4)
case("email_pseudo", "! mail {n}@{d}\n", "! mail user-{w}@example.com\n", {"policy": {"emails": "pseudo"}}, NAMES,
     {"w": duck_tag("username", concat("netop{k}#0", {"k": "c_custkey"}), 4)}, 1)
case("asn_path_prepend", "router bgp 23456\n set as-path prepend 70{k} 23456 70{k}\n", "router bgp 23456\n set as-path prepend <ASN-{w}> 23456 <ASN-{w}>\n",
     {"as-numbers": {"default": "hash"}}, {"k": "c_custkey % 100"}, {"w": duck_tag("asn", "concat('70', c_custkey % 100)")}, 2)
case("mac_bare_context", "mac-address {h}\nnote {h}\n", "mac-address 00005e000000\nnote {h}\n", {"macs": {"oui": "redact", "nic": "redact"}}, {"h": "concat('0a1b2c', lpad(CAST(c_custkey AS STRING), 6, '0'))"}, {}, 1)
NET6 = "concat('2a00:', 1 + c_custkey % 9998, '::')"
SLOT6 = duck_mod(duck_hmac("v6net", NET6), 1 << 32)
case("ipv6_hash", "ipv6 address 2a00:{k}::1/64\nipv6 host ::1\n", "ipv6 address {w}/64\nipv6 host ::1\n", {"ipv6": {"other_unicast": "hash"}}, {"k": "1 + c_custkey % 9998"},
     {"w": f"concat('<IP6-', {duck_tag('ip6', concat('2a00:{k}::1', {'k': '1 + c_custkey % 9998'}))}, '>')"}, 1)
case("ipv6_pseudo", "ipv6 address 2a00:{k}::1/64\nipv6 host 2a00:{k}::abc\n", "ipv6 address {w}1/64\nipv6 host {w}abc\n", {"ipv6": {"other_unicast": "pseudo"}}, {"k": "1 + c_custkey % 9998"},
     {"w": f"concat('2001:db8:', lower(to_hex({SLOT6} // 65536)), CASE WHEN {SLOT6} % 65536 = 0 THEN '' ELSE ':' || lower(to_hex({SLOT6} % 65536)) END, '::')"}, 2)
case("ipv6_redact", "ipv6 address 2a00:{k}::1/64\nipv6 host ::1\n", "ipv6 address 2001:db8::/64\nipv6 host ::1\n", {"ipv6": {"other_unicast": "redact"}}, {"k": "1 + c_custkey % 9998"}, {}, 1)


def operational(kind: str, marker: str, before: str, after: str, value: str = "concat('Nm', c_custkey)", changes: int = 2) -> None:
    case(f"op_name_{kind.replace('-', '_')}", before, after, {"operational-names": {kind: "hash"}}, {"v": value}, {"w": f"concat('<{marker}-', {duck_tag(marker.lower(), f'lower({value})')}, '>')"}, changes)


operational("acl-firewall-filter", "ACL", "ip access-list extended {v}\n ip access-group {v} in\n", "ip access-list extended {w}\n ip access-group {w} in\n")
operational("route-map", "ROUTE-MAP", "route-map {v} permit 10\n neighbor 10.0.0.1 route-map {v} out\n", "route-map {w} permit 10\n neighbor 10.0.0.1 route-map {w} out\n")
operational("prefix-list", "PREFIX-LIST", "ip prefix-list {v} seq 5 permit 10.0.0.0/8\n match ip address prefix-list {v}\n", "ip prefix-list {w} seq 5 permit 10.0.0.0/8\n match ip address prefix-list {w}\n")
operational("policy-statement", "POLICY", "policy-statement {v} {\n}\nimport [ {v} ];\n", "policy-statement {w} {\n}\nimport [ {w} ];\n")
operational("vrf", "VRF", "vrf definition {v}\n vrf forwarding default\n vrf forwarding {v}\n", "vrf definition {w}\n vrf forwarding default\n vrf forwarding {w}\n")
operational("peer-group", "PEER-GROUP", " neighbor {v} peer group\n neighbor 10.0.0.1 peer group {v}\n", " neighbor {w} peer group\n neighbor 10.0.0.1 peer group {w}\n")
operational("label-switched-path", "LSP", "label-switched-path {v} {\nlsp-next-hop {v};\n", "label-switched-path {w} {\nlsp-next-hop {w};\n")
operational("routing-filter-chain", "FILTER-CHAIN", "/routing filter rule\nadd chain={v} rule=accept\n/routing bgp connection\nadd input.filter={v}\n", "/routing filter rule\nadd chain={w} rule=accept\n/routing bgp connection\nadd input.filter={w}\n")
operational("fortios-interface", "FOS-IF", 'config system interface\n    edit "{v}"\n    next\nend\nconfig firewall policy\n    set srcintf "port2" "{v}"\nend\n', 'config system interface\n    edit "{w}"\n    next\nend\nconfig firewall policy\n    set srcintf "port2" "{w}"\nend\n')
case("op_name_terms", "policy-statement P{k} {\n    term T{k} {\n    }\n}\n", "policy-statement <POLICY-{p}> {\n    term <POLICY-TERM-{t}> {\n    }\n}\n", {"operational-names": {"policy-statement": "hash"}}, {"k": "c_custkey"},
     {"p": duck_tag("policy", "concat('p', c_custkey)"), "t": duck_tag("policy-term", "concat('p', c_custkey, chr(0), 't', c_custkey)")}, 2)
case("op_name_groups", "groups {\n    G{k} {\n        mtu 9000;\n    }\n}\napply-groups G{k};\n", "groups {\n    <CONFIG-GROUP-{w}> {\n        mtu 9000;\n    }\n}\napply-groups <CONFIG-GROUP-{w}>;\n",
     {"operational-names": {"configuration-group": "hash"}}, {"k": "c_custkey"}, {"w": duck_tag("config-group", "concat('g', c_custkey)")}, 2)


@register("identity_dedup", """SELECT c_custkey, 'hostnames' AS family, concat('Edge', c_custkey) AS value, 1 AS first_line FROM customer
UNION ALL SELECT c_custkey, 'usernames', concat('op', c_custkey), 3 FROM customer UNION ALL SELECT c_custkey, 'emails', concat('op', c_custkey, '@m', c_custkey % 7, '.test'), 4 FROM customer
UNION ALL SELECT c_custkey, 'domains', concat('m', c_custkey % 7, '.test'), 4 FROM customer""")
def identity_dedup(spark, sf_dir):
    text = concat("hostname Edge{k}\nhostname EDGE{k}\nusername op{k}\ncontact op{k}@m{m}.test\nip domain-name M{m}.test\n", {"k": "c_custkey", "m": "c_custkey % 7"}, True)
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    return corpus.identities(corpus.sanitise(docs, Policy(), SALT), "c_custkey")


@register("labels_rewrite", f"SELECT c_custkey, concat({DEVICE}, '_192.0.2.0.cfg') AS label, CAST(2 AS BIGINT) AS changes FROM customer")
def labels_rewrite(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(concat("hostname {v}\nip address 10.0.0.1 255.0.0.0\n", NAMES, True)).alias("text"),
        F.create_map(F.lit("file"), F.expr(concat("{v}_10.9.8.7.cfg", NAMES, True))).alias("labels"))
    folded = corpus.sanitise(docs, Policy({"policy": {"hostnames": "pseudo"}, "ipv4": {"default": "redact"}}), SALT, labels="labels")
    return folded.select("c_custkey", F.col("labels")["file"].alias("label"), F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("changes"))


@register("op_reference_agreement", """SELECT l.l_orderkey, count(*) AS refs, count(DISTINCT o.o_orderkey) AS declared FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey""")
def op_reference_agreement(spark, sf_dir):
    """References are counted by name before they are tagged; a name's tag then goes with it, so its group stays where the join put it."""
    from umbra.functions.digests import keyed

    def tagged(key: str) -> Column:
        return F.unhex(keyed(SALT, "route-map", F.concat(F.lit("rm"), key))).alias("tag")

    declared = table(spark, sf_dir, "orders").select(tagged("o_orderkey"), "o_orderkey")
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select(tagged("l_orderkey"), "l_orderkey", "n")
    both = refs.join(declared, "tag").groupBy("tag", "l_orderkey").agg(F.sum("n").alias("refs"), F.countDistinct("o_orderkey").alias("declared"))
    return both.select("l_orderkey", "refs", "declared")


@register("op_dangling_references", "SELECT l_orderkey AS doc, concat('RM', l_partkey) AS name, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> l_orderkey % 5 GROUP BY 1, 2")
def op_dangling_references(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("RM"), "l_partkey").alias("name"), "l_partkey")
    declared = lines.where("l_partkey % 5 = doc % 5").select("doc", F.lower("name").alias("name")).distinct()
    return reports.dangling(declared, lines, "doc").groupBy("doc", "name").agg(F.count("*").alias("n"))


@register("identity_native", """SELECT c_custkey, 'hostnames' AS family, concat('Edge', c_custkey) AS value, 1 AS first_line FROM customer
UNION ALL SELECT c_custkey, 'usernames', concat('op', c_custkey), 3 FROM customer UNION ALL SELECT c_custkey, 'emails', concat('op', c_custkey, '@m', c_custkey % 7, '.test'), 4 FROM customer
UNION ALL SELECT c_custkey, 'domains', concat('m', c_custkey % 7, '.test'), 4 FROM customer""")
def identity_native(spark, sf_dir):
    text = concat("hostname Edge{k}\nhostname EDGE{k}\nusername op{k}\ncontact op{k}@m{m}.test\nip domain-name M{m}.test\n", {"k": "c_custkey", "m": "c_custkey % 7"}, True)
    return identities.declared(table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text")), "c_custkey")


FLEET = "concat('10.', c_custkey // 256, '.', c_custkey % 256, '.0')"


@register("fleet_networks", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c_custkey) AS i, {FLEET} AS original, {duck_mod(duck_hmac('v4net', FLEET), 16896)} AS seed FROM customer),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS original, CAST(NULL AS BIGINT) AS slot, CAST([] AS BIGINT[]) AS taken
  UNION ALL SELECT i, original, slot, list_append(taken, slot) FROM (
    SELECT v.i, v.original, CAST(list_filter(list_transform(range(0, 16), lambda j: (v.seed + j) % 16896), lambda x: NOT list_contains(w.taken, x))[1] AS BIGINT) AS slot, w.taken
    FROM walk w JOIN v ON v.i = w.i + 1) t),
p AS (SELECT original, CASE WHEN slot < 512 THEN 3323068416 + slot * 256 ELSE 1681915904 + (slot - 512) * 256 END AS net FROM walk WHERE i > 0)
SELECT original, concat(net // 16777216, '.', (net // 65536) % 256, '.', (net // 256) % 256, '.0') AS pseudonym FROM p""")
def fleet_networks(spark, sf_dir):
    """Every network of a fleet, in first-come order, against probing one after another."""
    text = F.expr("concat('ip route 10.', c_custkey div 256, '.', c_custkey % 256, '.9 255.255.255.0')")
    return identities.fleet_networks(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), SALT, "c_custkey")


@register("sql_table_function", "SELECT c_custkey, 1 AS line_no, 'enable secret <REMOVED>' AS line FROM customer")
def sql_table_function(spark, sf_dir):
    from umbra.functions.table import register as register_functions

    register_functions(spark, Policy(), SALT)
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr("concat('enable secret S', c_custkey)").alias("text"))
    return spark.sql("SELECT c_custkey, f.line_no, f.line FROM {docs}, LATERAL sanitised_lines(text) f", docs=docs)
