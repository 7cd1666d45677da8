"""Plans that keep what one task holds, and what moves, in proportion to the input."""

from __future__ import annotations

import re

import pytest

from umbra.catalogue import QUERIES
from umbra.operators import identities, reports
from umbra.plans import rulebook as book

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unbroadcast(spark):
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    yield spark
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(key)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_move_once_a_name_and_stay_after_the_join(unbroadcast):
    above, join, below = plan(QUERIES["op_reference_agreement"](unbroadcast, SF)).partition("SortMergeJoin")
    assert join
    assert "Exchange" not in above
    assert below.count("Exchange") == 3  # references by name, then both sides by tag


def test_declared_names_stay_where_their_texts_were_dealt(spark):
    text = plan(QUERIES["identity_native"](spark, SF))
    assert text.count("Exchange") == 1
    assert "REPARTITION_BY_NUM" in text


def test_the_first_spelling_in_a_line_wins(spark):
    docs = spark.createDataFrame([(1, "domain-search [ B.test a.test A.test b.test ]\n"), (1, "hostname x\n"), (2, "contact u@A.test v@a.test\n")], "id int, text string")
    got = {(r.id, r.family, r.value) for r in identities.declared(docs, "id").collect()}
    assert {x for x in got if x[1] == "domains"} == {(1, "domains", "B.test"), (1, "domains", "a.test"), (2, "domains", "A.test")}
    assert (1, "hostnames", "x") in got


def test_line_checks_run_on_all_cores(spark):
    assert QUERIES["verify_line_checks"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


LINES = [
    "password hunter2", "PASSWORD hunter2", "paſſword hunter2", "no service password-encryption", "secret-data", "key 7 0A1B2C3D", "set community x", "x $9$ab", "$6$ab", "ssh-rsa " + "A" * 20,
    "a" * 24, "a" * 23, "A1" * 20, "config set secret x", "/user add password=x", "community 1:2 password y", "terminal user name root pw *x", "<SECRET-0a1b2c>", "", "plain words", "auth" + "/* SECRET-DATA */" + "x",
]


def test_line_checks_are_those_of_the_patterns(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*LINES, None])], "i int, line string")
    got = {r.i: r.c for r in rows.select("i", reports.line_checks(rows.line).alias("c")).collect()}
    ignored = re.compile("|".join(book.IGNORED), re.I)
    want = {i: [n for n, p, _ in book.CHECKS if n != "pem-left" and re.search(p, ignored.sub(" ", x))] for i, x in enumerate(LINES)} | {len(LINES): []}
    assert got == want
