"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from concordia.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 5) if isinstance(v, int | float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(core.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_full_chain_verifies(spark):
    from concordia.operators import audit

    c = core.full_chain(spark, SF)
    assert audit.broken_links(c).isEmpty() and audit.forks(c).isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_component_order_places_every_component(spark):
    import pyarrow.parquet as pq

    sf = SF.replace("sf0.001", "sf0.1")
    t = pq.read_table(f"{sf}/supplier.parquet", columns=["s_suppkey", "s_nationkey", "s_name"]).to_pylist()
    want = [r["s_suppkey"] for r in sorted(t, key=lambda r: (r["s_nationkey"], r["s_name"], r["s_suppkey"]))]
    assert len(want) > 100
    assert {r["id"]: r["place"] for r in core.component_order(spark, sf).collect()} == {k: i + 1 for i, k in enumerate(want)}


def test_declared_bands_at_their_ends(spark, tmp_path):
    """Prices that lie on a band's end agree, as in the SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT p AS p_partkey, 'b' || p AS p_brand, (900 + p / 10)::DOUBLE AS p_retailprice, (1 + p % 50)::INTEGER AS p_size FROM range(1000) t(p)")
    con.execute("CREATE TABLE lineitem AS SELECT p_partkey AS l_partkey, 1.0::DOUBLE AS l_quantity, round(p_retailprice + s * p_retailprice * p_size / 100.0, 2)::DOUBLE AS l_extendedprice FROM part, (VALUES (-1), (1)) t(s)")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = {(r["brand"], r["n"], r["n_agree"]) for r in core.declared_bands(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(core.oracle_sql()["declared_bands"]).fetchall())


@pytest.mark.parametrize("name", ["flagship", "gate_blocks", "graded_sets", "band_verdicts", "text_verdicts", "unit_reconciliation"])
def test_pair_verdicts_are_compiled(spark, name):
    """The JVM interprets methods of more than 8,000 bytes of code for ever."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = core.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
        module = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = module.codegenStringSeq(plan)
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(sizes) <= 8000


def test_gates_read_the_pairs_once(spark):
    plan = core.gate_blocks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_ord") and sum("Join Inner" in line and "l_ord" in line for line in plan.splitlines()) == 1


def test_manifest_makes_the_queue_once(spark):
    plan = core.queries()["queue_manifest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "l_ord" in line for line in plan.splitlines()) == 1


def exchanges(spark, name: str) -> list[str]:
    """The shuffles of a query's plan, without those that are read again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = core.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]


@pytest.mark.parametrize("name", ["flagship", "gate_blocks"])
def test_claims_are_shuffled_once(spark, name):
    assert sum("hashpartitioning(part#" in line for line in exchanges(spark, name)) == 1


def shuffled(spark, name: str, sf: str) -> tuple[list, int]:
    """A query's rows, and how many rows its shuffles wrote."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = core.queries()[name](spark, sf)
        rows, plans, written = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
        while plans:
            p = plans.pop()
            plans += [p.children().apply(i) for i in range(p.children().size())]
            written += p.metrics().apply("shuffleRecordsWritten").value() if p.nodeName() == "Exchange" else 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return rows, written


def test_manifest_shuffles_no_ids_of_its_own(spark):
    """Entries are counted where they are made; what is shuffled grows with the claims and not with their pairs."""
    rows, written = shuffled(spark, "queue_manifest", SF.replace("sf0.001", "sf0.1"))
    assert 0 < written < rows[0]["n_ids"]


def test_sets_shuffle_claims_for_themselves_and_their_pairs_alone(spark):
    _, written = shuffled(spark, "graded_sets", SF)
    claims = core.table(spark, SF, "lineitem").count()
    assert 2 * claims <= written < 3 * claims
