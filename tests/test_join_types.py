import pyarrow as pa
import pyarrow.parquet as pq
from sqlquarry.operators import catalogue

from tests.oracle import TABLES, assert_same

LINES = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_returnflag": pa.string()}
PARTS = {"p_partkey": pa.int64(), "p_brand": pa.string(), "p_type": pa.string(), "p_size": pa.int32()}


def write(folder, lines, parts):
    for name in TABLES:
        rows, schema = {"lineitem": (lines, LINES), "part": (parts, PARTS)}.get(name, ([(0,)], {"x": pa.int32()}))
        pq.write_table(pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], names=list(schema)), f"{folder}/{name}.parquet")


def test_keys_that_add_up_to_one_number(spark, tmp_path):
    """Orders and suppliers beyond 100, null keys, brands that begin otherwise, against the SQL."""
    lines = [(o, o % 3 if o % 7 else None, s, "R" if o % 5 else "A") for o in range(1, 40) for s in (o, o + 100, o + 200, 100 * o, None)]
    lines += [(1, 1, 207, "R"), (2, 1, 107, "R"), (3, 1, 7, "R"), (3, 1, 7, "R"), (None, 1, 7, "R"), (1, 2, 5, None)]
    parts = [(0, "Brand#1", "SMALL", 3), (1, "Label#2", "LARGE", 9), (2, "Brand#3", None, 1), (4, "Brand#3", "SMALL", 50), (None, "Brand#4", "SMALL", 1)]
    write(tmp_path, lines, parts)
    assert_same(spark, "join_type_report", str(tmp_path))


def test_no_small_part(spark, tmp_path):
    write(tmp_path, [(1, 1, 1, "R")], [(1, "Brand#1", "SMALL", 30)])
    assert_same(spark, "join_type_report", str(tmp_path))


def test_columns_of_a_base_type(spark):
    columns = spark.createDataFrame([(1, "decimal(1,2)", "Float"), (2, "int", "Int")], "id int, column_type_original string, column_base_type string")
    usage = spark.createDataFrame([(1, 10, "JOIN"), (1, 11, "JOIN"), (1, 12, "WHERE"), (2, 10, "JOIN")], "column_id int, query_id int, operator_type string")
    queries = spark.createDataFrame([(10, 3), (11, 2), (12, 1)], "id int, repo_id int")
    assert [tuple(r) for r in catalogue.join_types(usage, columns, queries).collect()] == [("decimal(1,2)", "Float", 2, [2, 3])]
    assert len(catalogue.join_types(usage, columns, queries, base=None).collect()) == 2
