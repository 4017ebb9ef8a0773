"""Registration of named queries."""

from __future__ import annotations

from loomgraph.operators.stored import spread

#: Tables of long rows, and what tells their rows apart.
KEYS = {"documents": "doc_id", "pages": "page_id"}
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register fn(t) where t(table) reads a table of the input folder; sql is its DuckDB equivalent."""

    def keep(fn):
        def run(spark, sf_dir):
            def read(table):
                df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                return spread(df, KEYS[table]) if table in KEYS else df

            return fn(read)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return keep
