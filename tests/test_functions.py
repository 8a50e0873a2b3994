import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sqlquarry.functions import dates, names, reports, statements, types


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("r")).first()["r"]


def brute_split(sql):
    out, quote, now = [], "", ""
    for c in sql:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        if c == ";" and not quote:
            out.append(now)
            now = ""
        else:
            now += c
    return [s.strip() for s in [*out, now] if s.strip()]


def brute_tidy(sql):
    sql = re.sub(r"--[^\n]*\n?", " ", sql)
    sql = " ".join(re.sub(r"/\*.*?\*/", " ", sql, flags=re.DOTALL).split())
    return " ".join(re.sub(r"([(),=<>+\-*/])", r" \1 ", sql).split()).lower()


TEXTS = st.text(alphabet="ab;'\"-/*\n\t ()=<>,.É\xa0\r", max_size=40)


def test_split_and_tidy_against_brute_force(spark):
    texts: list[str] = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(TEXTS)
    def collect(t):
        texts.append(t)

    collect()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("t", statements.split_statements(F.col("t")).alias("s"), statements.tidy(F.col("t")).alias("y")).collect()
    for r in rows:
        assert r["s"] == brute_split(r["t"])
        assert r["y"] == brute_tidy(r["t"]), repr(r["t"])


def test_long_script(spark):
    text = "select 'x'; " * 300_000
    assert len(one(spark, statements.split_statements(F.col("t")), t=text)) == 300_000


def test_signs_of_sql(spark):
    looks = lambda t: one(spark, statements.looks_like_sql(F.col("t")), t=t)
    assert looks("select a from b") and looks("delete from t where x") and looks("create table copyright ")
    assert not looks("delete from t") and not looks("update t set a = 1 where b = 2") and not looks("selection from x")
    assert looks("alter from from create typeunion ") and looks("create typeunion(") and not looks("select " * 9)
    rng = random.Random(1)
    parts = [*statements.SIGNS, *statements.FIRST_WORDS, " ", " ", "(", ")", "x", "\n"]
    texts = [rng.choice(statements.FIRST_WORDS) + " " + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    brute = lambda t: t.strip().startswith(tuple(f"{w} " for w in statements.FIRST_WORDS)) and sum(s + e in t for s in statements.SIGNS for e in " ()") >= 2
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", statements.looks_like_sql(F.col("t")).alias("r")).collect()
    assert all(r["r"] == brute(r["t"]) for r in rows) and 50 < sum(r["r"] for r in rows) < 1400
    assert looks("select " + "from " * 400_000 + "where ")
    kind = lambda t: one(spark, statements.query_type(F.col("t")), t=t)
    assert [kind(t) for t in ("selected", "with a", "Drop", "from x")] == ["SELECT", "WITH", "DROP", "UNKNOWN"]


def test_prepare(spark):
    ready = lambda t: one(spark, statements.prepare(F.col("t")), t=t)
    assert ready("select `a` where b > = %s LIMIT 5 , 10") == 'select "a" where b >= :param_name limit 10 offset 5'
    assert ready("x < > y and rand ( ) = ${ z } and #{q}") == "x < > y and random() = $:z and :q"
    assert ready("like '%india%'") == "like ':param_namendia%'"


def test_names(spark):
    repo = lambda u: one(spark, names.repository(F.col("u")), u=u)
    assert tuple(repo("https://gitlab.example.org/a/b/c")) == ("b", "https://gitlab.com/a/b")
    assert tuple(repo("https://gitlab.com/github/b")) == ("b", "https://github.com/github/b")
    assert repo("http://x.org/a/b") is None and repo("https://github.com/a") is None
    table = lambda s: one(spark, names.ddl_table(F.col("s")), s=s)
    assert table("  create\n table if not exists `A`.`B` (x int)") == "`b"
    assert table('CREATE OR REPLACE TABLE "X.y"') == "y" and table("create temp table t") is None
    assert one(spark, names.storage_key(F.col("u")), u="https://gitlab.com/a/b") == "gitlab.com_a_b"


def test_types(spark):
    unify = lambda t: tuple(one(spark, types.unify(F.col("t")), t=t))
    for raw, want in {
        "int8": ("Int8", "Int"), "bit": ("Int8", "Int"), "long varchar": ("Int64", "Int"), "numeric(10,2)": ("Float", "Float"),
        "NUMBER(10)": ("number(10,0)", "Int"), "decimal(5,2) unsigned": ("number(5,2)", "Float"), "decimal": ("decimal", "Int"),
        "Int Unsigned": ("UInt32", "Int"), "character(10)": ("VARCHAR", "Text"), "interval": ("Timestamp", "DateTime"),
        "money": ("OTHER", "OTHER"), "uuid": ("UUID", "Int"), "array": ("ARRAY", "ARRAY"), None: ("OTHER", "OTHER"), "": ("OTHER", "OTHER"),
    }.items():
        assert unify(raw) == want, raw
    means = lambda n, b: one(spark, types.meaning(F.col("n"), F.col("b")), n=n, b=b)
    assert [means("width", "Int"), means("price", "Int"), means("price_date", "Text"), means("x", "JSON"), means("x", "Text"), means("id", "Boolean")] == ["ID", "AMOUNT", "DATE", "JSON", None, "BOOLEAN"]


def test_dates_and_reports(spark):
    dates.install(spark)
    got = spark.sql("SELECT add_days(TIMESTAMP_NTZ'2024-01-31 10:00:00', 30) a, add_years(TIMESTAMP_NTZ'2024-02-29 00:00:00', 1) b").first()
    assert str(got["a"]) == "2024-03-01 10:00:00" and str(got["b"]) == "2025-02-28 00:00:00"
    assert str(one(spark, dates.add_months(F.col("d").cast("timestamp_ntz"), F.lit(1)), d="2024-01-31")) == "2024-02-29 00:00:00"
    assert one(spark, reports.success_rate(F.col("a"), F.col("b")), a=0, b=0) == 0 and one(spark, reports.per_minute(F.col("a"), F.col("b")), a=5, b=0) == 0
    assert [one(spark, reports.duration(F.col("s")), s=s) for s in (5.0, 90.0, 7200.0)] == ["5.00 seconds", "1.50 minutes", "2.00 hours"]


def test_context(spark):
    part = lambda t, off: one(spark, statements.context(F.col("t"), F.lit(off)), t=t)
    text = "".join(chr(33 + i % 90) for i in range(1000))
    assert part(text, 400) == text[389 : 1000 - 300 + 1]
    assert part("short", 400) == ""
