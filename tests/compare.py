"""Compare a registered query with its oracle, value by value."""

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAMILY = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
          "VARCHAR": "string", "BOOLEAN": "boolean"}


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark frame and an oracle text; empty when equal."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in res.description}
    want = res.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} but oracle {sorted(names)}"]
    for f in df.schema.fields:
        if f.dataType.simpleString() != kinds[f.name]:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} but oracle {kinds[f.name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    expected = Counter(tuple(_plain(r[i]) for i in at) for r in want)
    got = Counter(tuple(_plain(v) for v in r) for r in df.select(*order).collect())
    if not want:
        out.append("oracle gives no rows")
    if expected != got:
        out.append(f"rows {sum(got.values())} against {sum(expected.values())}")
        out += [f"only spark {n}x {dict(zip(order, r))}" for r, n in list((got - expected).items())[:2]]
        out += [f"only oracle {n}x {dict(zip(order, r))}" for r, n in list((expected - got).items())[:2]]
    return out
