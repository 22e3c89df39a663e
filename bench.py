"""

The main figure is a change log of all ``lineitem`` rows: written once to the shared folder as raw events, then read,
framed into headers, checked, joined with its table map, decoded to row images and turned into a typed view.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.functions import codec as C
from rowtide.operators import decode as D
from rowtide.plans import catalog
from rowtide.plans import changelog as L
from rowtide.sources import framing

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
LINEITEM = [("l_orderkey", C.LONGLONG, 0), ("l_partkey", C.LONGLONG, 0), ("l_linenumber", C.LONG, 0), ("l_quantity", C.DOUBLE, 8), ("l_extendedprice", C.DOUBLE, 8), ("l_returnflag", C.VARCHAR, 10), ("l_shipdate", C.DATETIME2, 0)]
TYPED = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz"}
NAMES = ["insert_roundtrip", "types_int_matrix", "update_pairs", "op_counts", "filter_precedence", "schema_asof", "header_fields", "crc_verify", "txn_commit_boundary", "gtid_intervals", "latest_state", "column_diff", "maria_compressed"]


def timed(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    shared = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(*[F.col(n).cast("timestamp_ntz") if k == C.DATETIME2 else F.col(n) for n, k, _ in LINEITEM])
    rows = rows.repartition(4 * int(CPUS))
    n = rows.count()
    L.table_log(rows, "shop", "lineitem", LINEITEM).write.parquet(f"{shared}/log")
    raw = spark.read.parquet(f"{shared}/log")
    timed(D.with_header(raw, "crc32"))  # warm
    steps = {
        "log_header_crc": D.with_header(raw, "crc32").groupBy(B.kind_name()).agg(F.count_if("crc_ok")),
        "log_schema_asof": D.with_map_seq(D.with_header(raw)),
        "log_decode": D.changes(raw),
        "log_typed_view": D.typed(D.changes(raw), TYPED),
        "log_typed_columns": D.decode_columns(D.attach(D.with_header(raw)), {n: (k, t) for k, (n, t) in enumerate(TYPED.items())}),
    }
    framing.write_files(raw, f"{shared}/files")
    files = framing.read_files(spark, f"{shared}/files")
    steps |= {"log_files": D.changes(files), "log_files_typed": D.view(files, "shop", "lineitem")}
    seconds = {name: timed(df) for name, df in steps.items()}
    every = catalog.queries()
    seconds |= {name: timed(every[name](spark, SF_DIR)) for name in NAMES}
    seconds = {k: round(v, 3) for k, v in seconds.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "rows": n, "rows_per_sec_decoded": round(n / seconds["log_typed_columns"]), "rows_per_sec_from_files": round(n / seconds["log_files_typed"]), "cpus": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
