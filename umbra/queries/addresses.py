"""Addresses, MACs, AS numbers and e-mail addresses: native expressions against integer arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions import addresses as A
from umbra.functions.digests import tag
from umbra.functions.ipv6 import ipv6_class
from umbra.plans import rulebook as book
from umbra.queries.base import SALT, duck_hmac, duck_tag, register, table

WORD = r"[^\p{L}\p{N}_.]+"
VALID = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"
DUCK_QUADS = rf"""quads AS (SELECT doc_id, q FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{WORD}')) AS q FROM documents) t
    WHERE regexp_full_match(q, '([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}'))"""
#: Synthetic quads: every class, masks now and then, and octets out of range
QUAD = """CASE c_custkey % 11 WHEN 0 THEN concat('255.255.', (c_custkey * 8) % 256, '.0') WHEN 1 THEN concat('10.', c_custkey % 256, '.', (c_custkey * 7) % 256, '.', (c_custkey * 13) % 300)
 WHEN 2 THEN concat('100.', 60 + c_custkey % 80, '.1.', c_custkey % 256) WHEN 3 THEN concat('198.', 17 + c_custkey % 4, '.', c_custkey % 256, '.9') WHEN 4 THEN '0.0.0.255'
 WHEN 5 THEN concat('172.', 14 + c_custkey % 20, '.3.', c_custkey % 256) WHEN 6 THEN '8.8.8.8' WHEN 7 THEN concat(224 + c_custkey % 32, '.0.0.', 2 + c_custkey % 250)
 WHEN 8 THEN concat('192.0.', c_custkey % 3, '.', c_custkey % 256) ELSE concat(1 + c_custkey % 223, '.', (c_custkey * 3) % 256, '.', (c_custkey * 5) % 256, '.', (c_custkey * 7) % 256) END"""


def duck_number(q: str) -> str:
    parts = " + ".join(f"CAST(split_part({q}, '.', {i + 1}) AS BIGINT) * {1 << (24 - 8 * i)}" for i in range(4))
    return f"CASE WHEN regexp_full_match({q}, '{VALID}') THEN {parts} END"


def duck_class(n: str, q: str) -> str:
    import ipaddress

    arms = "".join(
        f" WHEN {n} BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)} THEN '{name}'"
        for name, nets in book.V4_CLASSES for net in map(ipaddress.ip_network, nets)
    )
    return f"CASE WHEN {n} IS NULL THEN NULL{arms} WHEN {q} IN ({', '.join(repr(r) for r in book.V4_RESOLVERS)}) THEN 'well_known' ELSE 'other_unicast' END"


def duck_mask(n: str) -> str:
    return f"((4294967295 - {n}) & (4294967296 - {n}) = 0 OR {n} & ({n} + 1) = 0)"


def duck_mod(digest: str, n: int) -> str:
    return f"list_reduce(list_transform(range(16), lambda i: CAST('0x' || substr({digest}, CAST(4 * i + 1 AS INTEGER), 4) AS BIGINT)), lambda a, b: (a * 65536 + b) % {n}, CAST(0 AS BIGINT))"


QUADS = f"WITH s AS (SELECT c_custkey, {QUAD} AS quad FROM customer), n AS (SELECT c_custkey, quad, {duck_number('quad')} AS num FROM s)"
NET = "concat(num // 16777216, '.', (num // 65536) % 256, '.', (num // 256) % 256, '.0')"


def quads(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(QUAD).alias("quad"))
    return rows.withColumn("num", A.ipv4_number(F.col("quad")))


def found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[0-9]\.[0-9]"))
    rows = docs.select("doc_id", F.explode(A.ipv4_candidates(F.col("text"))).alias("q"))
    return rows.withColumn("num", A.ipv4_number(F.col("q")))


@register("ipv4_extract", f"WITH {DUCK_QUADS} SELECT doc_id, q AS quad, count(*) AS n FROM quads GROUP BY doc_id, q")
def ipv4_extract(spark, sf_dir):
    return found(spark, sf_dir).groupBy("doc_id", F.col("q").alias("quad")).agg(F.count("*").alias("n"))


@register("ipv4_class_report", f"""WITH {DUCK_QUADS}, n AS (SELECT q, {duck_number('q')} AS num FROM quads)
SELECT {duck_class('num', 'q')} AS class, count(*) AS n, count(DISTINCT q) AS distinct_addresses FROM n WHERE num IS NOT NULL AND NOT {duck_mask('num')} GROUP BY 1""")
def ipv4_class_report(spark, sf_dir):
    rows = found(spark, sf_dir).where(F.col("num").isNotNull() & ~A.mask_like(F.col("num")))
    return rows.groupBy(A.ipv4_class(F.col("num"), F.col("q")).alias("class")).agg(F.count("*").alias("n"), F.countDistinct("q").alias("distinct_addresses"))


@register("ipv4_mask_exempt", f"{QUADS} SELECT c_custkey, quad, num IS NOT NULL AS valid, coalesce({duck_mask('num')}, false) AS mask FROM n")
def ipv4_mask_exempt(spark, sf_dir):
    n = F.col("num")
    return quads(spark, sf_dir).select("c_custkey", "quad", n.isNotNull().alias("valid"), F.coalesce(A.mask_like(n), F.lit(False)).alias("mask"))


@register("ipv4_keep_networks", f"{QUADS} SELECT c_custkey, quad, {duck_class('num', 'quad')} AS class, num BETWEEN 167772160 AND 176160767 AS spared FROM n WHERE num IS NOT NULL")
def ipv4_keep_networks(spark, sf_dir):
    n = F.col("num")
    return quads(spark, sf_dir).where(n.isNotNull()).select("c_custkey", "quad", A.ipv4_class(n, F.col("quad")).alias("class"), A.within(n, "10.0.0.0/9").alias("spared"))


@register("ipv4_hash", f"{QUADS} SELECT c_custkey, quad, CASE WHEN num IS NULL OR {duck_mask('num')} THEN quad ELSE '<IP-' || {duck_tag('ip', 'quad')} || '>' END AS rendered FROM n")
def ipv4_hash(spark, sf_dir):
    n = F.col("num")
    return quads(spark, sf_dir).select("c_custkey", "quad", F.when(n.isNull() | A.mask_like(n), F.col("quad")).otherwise(A.ipv4_hash(F.col("quad"), SALT)).alias("rendered"))


@register("ipv4_redact", f"{QUADS} SELECT c_custkey, 'ip route ' || CASE WHEN num IS NULL OR {duck_mask('num')} THEN quad ELSE '192.0.2.0' END || ' 255.255.255.0' AS line FROM n")
def ipv4_redact(spark, sf_dir):
    n = F.col("num")
    new = F.when(n.isNull() | A.mask_like(n), F.col("quad")).otherwise(F.lit("192.0.2.0"))
    return quads(spark, sf_dir).select("c_custkey", F.concat(F.lit("ip route "), new, F.lit(" 255.255.255.0")).alias("line"))


@register("ipv4_pseudo_seed", f"""{QUADS}, d AS (SELECT c_custkey, quad, num, {duck_hmac('v4net', NET)} AS digest FROM n WHERE num IS NOT NULL),
i AS (SELECT *, {duck_mod('digest', 16896)} AS slot FROM d), p AS (SELECT *, CASE WHEN slot < 512 THEN 3323068416 + slot * 256 ELSE 1681915904 + (slot - 512) * 256 END AS net FROM i)
SELECT c_custkey, quad, slot, concat(net // 16777216, '.', (net // 65536) % 256, '.', (net // 256) % 256, '.', num % 256) AS first_candidate FROM p""")
def ipv4_pseudo_seed(spark, sf_dir):
    rows = quads(spark, sf_dir).where(F.col("num").isNotNull()).withColumn("slot", A.ipv4_seed(F.col("num"), SALT))
    return rows.select("c_custkey", "quad", "slot", A.ipv4_text(A.pool_slot(F.col("slot")) + F.col("num") % 256).alias("first_candidate"))


@register("ipv4_pool_collisions", f"{QUADS} SELECT quad, count(*) AS n FROM n WHERE num BETWEEN 3323068416 AND 3323199487 OR num BETWEEN 1681915904 AND 1686110207 GROUP BY quad")
def ipv4_pool_collisions(spark, sf_dir):
    inside = A.within(F.col("num"), book.V4_POOLS[0]) | A.within(F.col("num"), book.V4_POOLS[1])
    return quads(spark, sf_dir).where(inside).groupBy("quad").agg(F.count("*").alias("n"))


V6 = """CASE c_custkey % 10 WHEN 0 THEN '::' WHEN 1 THEN '::1' WHEN 2 THEN concat('fd00::', c_custkey % 9999) WHEN 3 THEN concat('fe80::1:', c_custkey % 9999) WHEN 4 THEN concat('ff02::', 1 + c_custkey % 99)
 WHEN 5 THEN concat('2001:db8::', c_custkey % 9999) WHEN 6 THEN concat('2001:0:', c_custkey % 9999, '::1') WHEN 7 THEN concat('2002:', c_custkey % 9999, '::1') WHEN 8 THEN '2001:4860:4860::8888'
 ELSE concat('2a00:', c_custkey % 9999, '::7') END"""
V6_NAMES = ("unspecified", "loopback", "ula", "link_local", "multicast", "documentation", "teredo", "six_to_four", "well_known", "other_unicast")


@register("ipv6_class", f"SELECT c_custkey, {V6} AS address, CASE c_custkey % 10 {' '.join(f'WHEN {i} THEN {n!r}' for i, n in enumerate(V6_NAMES))} END AS class FROM customer")
def ipv6_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(V6).alias("address"))
    return rows.withColumn("class", ipv6_class("address"))


HEX = "lpad(lower(hex(c_custkey * 7919 % 16777216)), 6, '0')"
MAC = f"""CASE c_custkey % 4 WHEN 0 THEN concat('00:1b:44:', substr({HEX}, 1, 2), ':', substr({HEX}, 3, 2), ':', substr({HEX}, 5, 2)) WHEN 1 THEN concat('001B.44', substr({HEX}, 1, 2), '.', substr({HEX}, 3, 4))
 WHEN 2 THEN concat('00-1b-44-', substr({HEX}, 1, 2), '-', substr({HEX}, 3, 2), '-', substr({HEX}, 5, 2)) ELSE concat('00-00-5e-', substr({HEX}, 1, 2), '-', substr({HEX}, 3, 2), '-', substr({HEX}, 5, 2)) END"""


def macs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(MAC).alias("mac"))


@register("mac_redact_oui", f"SELECT c_custkey, {MAC} AS mac, CASE c_custkey % 4 WHEN 0 THEN '00:00:5e:00:00:00' WHEN 1 THEN '0000.5e00.0000' WHEN 2 THEN '00-00-5e-00-00-00' ELSE {MAC} END AS rendered FROM customer")
def mac_redact_oui(spark, sf_dir):
    return macs(spark, sf_dir).withColumn("rendered", A.mac_redacted(F.col("mac")))


DIGITS = f"lower(regexp_replace({MAC}, '[^0-9A-Fa-f]', '', 'g'))"


@register("mac_hash", f"SELECT c_custkey, {MAC} AS mac, '<MAC-' || {duck_tag('mac', DIGITS)} || '>' AS rendered FROM customer")
def mac_hash(spark, sf_dir):
    return macs(spark, sf_dir).withColumn("rendered", F.concat(F.lit("<MAC-"), tag(SALT, "mac", A.mac_digits(F.col("mac"))), F.lit(">")))


@register("mac_pseudo_seed", f"""WITH m AS (SELECT c_custkey, {MAC} AS mac, {DIGITS} AS d FROM customer),
h AS (SELECT *, CAST('0x' || substr({duck_hmac('mac-oui', 'substr(d, 1, 6)')}, 59, 6) AS BIGINT) & 4194303 AS c, CAST('0x' || substr(d, 1, 6) AS BIGINT) AS r, substr({duck_hmac('mac', 'd')}, 59, 6) AS nic FROM m),
j AS (SELECT *, lpad(lower(to_hex(((c >> 16) << 18) | (r & 196608) | (c & 65535))), 6, '0') || nic AS x FROM h)
SELECT c_custkey, mac, CASE c_custkey % 4 WHEN 0 THEN regexp_replace(x, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') WHEN 1 THEN regexp_replace(x, '(....)(....)(....)', '\\1.\\2.\\3')
 ELSE regexp_replace(x, '(..)(..)(..)(..)(..)(..)', '\\1-\\2-\\3-\\4-\\5-\\6') END AS first_candidate FROM j""")
def mac_pseudo_seed(spark, sf_dir):
    return macs(spark, sf_dir).withColumn("first_candidate", A.mac_seeded(F.col("mac"), SALT))


AS = "CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN CAST(64400 + c_custkey % 1200 AS STRING) WHEN 2 THEN CAST(4200000000 + c_custkey AS STRING) WHEN 3 THEN concat(c_custkey % 70000, '.', c_custkey % 66000) ELSE '23456' END"
AS_NUM = "CASE WHEN position('.' IN a) > 0 THEN CASE WHEN CAST(split_part(a, '.', 1) AS BIGINT) <= 65535 AND CAST(split_part(a, '.', 2) AS BIGINT) <= 65535 THEN CAST(split_part(a, '.', 1) AS BIGINT) * 65536 + CAST(split_part(a, '.', 2) AS BIGINT) END ELSE CAST(a AS BIGINT) END"
AS_SPACE = (
    "CASE WHEN n IS NULL OR " + " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in book.ASN_STAY) + " THEN NULL "
    + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in book.ASN_SPACES) + " END"
)
ASNS = f"WITH x AS (SELECT c_custkey, {AS} AS a FROM customer), y AS (SELECT *, {AS_NUM} AS n FROM x), z AS (SELECT *, {AS_SPACE} AS space FROM y)"


def asns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(AS).alias("a"))


@register("asn_namespace", f"{ASNS} SELECT c_custkey, a, space FROM z")
def asn_namespace(spark, sf_dir):
    return asns(spark, sf_dir).withColumn("space", A.asn_space(A.asn_number(F.col("a"))))


@register("asn_reserved_kept", f"{ASNS} SELECT a, count(*) AS n FROM z WHERE space IS NULL GROUP BY a")
def asn_reserved_kept(spark, sf_dir):
    return asns(spark, sf_dir).where(A.asn_space(A.asn_number(F.col("a"))).isNull()).groupBy("a").agg(F.count("*").alias("n"))


AS_ARMS = " ".join(f"WHEN '{s}' THEN {a} + {duck_mod(duck_hmac(s, 'CAST(n AS VARCHAR)'), b - a + 1)}" for a, b, s in book.ASN_SPACES)


@register("asn_pseudo_seed", f"{ASNS}, w AS (SELECT *, CASE space {AS_ARMS} END AS m FROM z) SELECT c_custkey, a, CASE WHEN m IS NULL THEN a WHEN position('.' IN a) > 0 THEN concat(m // 65536, '.', m % 65536) ELSE CAST(m AS VARCHAR) END AS first_candidate FROM w")
def asn_pseudo_seed(spark, sf_dir):
    return asns(spark, sf_dir).withColumn("first_candidate", A.asn_seeded(F.col("a"), SALT))


@register("email_redact", r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+')) AS emails,
 md5(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+', 'user@example.invalid', 'g')) AS redacted_md5
 FROM documents WHERE position('@' IN text) > 0""")
def email_redact(spark, sf_dir):
    rx = F.lit("(?U)" + book.EMAIL)
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.regexp_count("text", rx).cast("bigint").alias("emails"), F.md5(F.regexp_replace("text", "(?U)" + book.EMAIL, "user@example.invalid")).alias("redacted_md5"))
