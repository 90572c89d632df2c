"""Compare workload queries with their SQL equivalents: ``python tests/oracle_check.py DIR [name ...]``."""

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(root):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return db


def canonical(columns, rows):
    """Rows with their columns in name order, sorted; floats to 9 significant digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, root, query, sql):
    """None when both sides agree, else a short description of the difference."""
    df = query(spark, root)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(names, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(ours[0], a, b) if x != y]
            return f"first difference {a[:1]}: {bad}"
    return None


def main():
    from pyspark.sql import SparkSession

    from folia.workload.oracles import ORACLES
    from folia.workload.queries import QUERIES

    root, names = sys.argv[1], sys.argv[2:] or list(ORACLES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(root)
    for name in names:
        start = time.time()
        try:
            found = compare(spark, db, root, QUERIES[name], ORACLES[name])
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {str(found or '')[:700]}", flush=True)


if __name__ == "__main__":
    main()
