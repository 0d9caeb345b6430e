"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE = 4096
ROWS_A_RANGE = 20_000
LAST = "\U0010ffff"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    pattern = "^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER), F.regexp_extract(rest, pattern, 2)


def host_key(host: Column) -> Column:
    """``a.b.c`` -> ``c.b.a.``: a domain and all its subdomains are the strings that start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    rows_a_range: int = ROWS_A_RANGE,
) -> DataFrame:
    """(id, ``host``, ``path``, ``rule``, ``verdict``) per row of ``pages``.

    ``rules``: columns host, path, verdict. A rule fits its host and all subdomains if the path starts
    with the rule's; the longest host + path wins, ``block`` before other verdicts on a tie. No
    fitting rule: rule null, verdict ``default``. Null url, or no ``://``: host and path empty.

    A rule's host is an interval of reversed-host keys. Keys are cut into ranges at quantiles of a
    sample of 4,096 rows; the cuts also use path and a hash of the row, so a host that holds a third of
    all rows, or one url repeated without end, spreads over ranges. Each rule goes to the ranges that
    its interval meets. A task sorts a range and sweeps it with a stack of the nested rules that are
    open at the current key: a streaming pass whose memory is the stack. Nothing is broadcast but
    the cuts. Repeated rows each get their row; repeated rules count once.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.xxhash64(id_col, url_col).alias("__h"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    place = F.concat("key", F.lit("\0"), "path", F.lit("\0"), F.hex("__h"))
    total = pages.count()
    scale = 1 << 40  # the threshold lets about four times the sample through, however many tasks there are
    offered = rows.select(place.alias("p"), F.xxhash64("__h").alias("o")).where(F.pmod("o", F.lit(scale)) <= F.lit(min(scale, scale * 4 * SAMPLE // max(total, 1))))
    sample = sorted(r[0] for r in offered.orderBy("o", "p").limit(SAMPLE).collect())
    ranges = min(SAMPLE, max(8, -(-total // rows_a_range)))
    cuts = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []

    given = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host <> ''")
    given = given.groupBy("host", "path").agg(F.min(F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1), "verdict"))["verdict"].alias("verdict"))
    given = given.withColumn("key", host_key(F.col("host")))

    @F.pandas_udf("int")
    def range_of(x):
        return x.map(lambda p: bisect.bisect_right(cuts, p)).astype("int32")

    names = ["range", "key", "kind", "path", "id", "host", "verdict"]
    id_type = rows.schema["id"].dataType
    urls = rows.select(
        range_of(place).alias("range"), "key", F.lit(1).alias("kind"), "path", "id", "host", F.lit(None).cast("string").alias("verdict")
    )
    spread = F.explode(F.sequence(range_of(F.col("key")), range_of(F.concat("key", F.lit(LAST)))))
    marks = given.select(
        spread.alias("range"), "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(id_type).alias("id"), "host", "verdict"
    )
    events = urls.select(*names).union(marks.select(*names)).repartition("range").sortWithinPartitions("range", "key", "kind", "path")
    schema = T.StructType(
        [T.StructField("id", id_type)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []
        now = None
        for batch in batches:
            hosts, paths, found, verdicts, picked = [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            for i, (part, key, kind, path, host, verdict) in enumerate(zip(*columns)):
                if part != now:
                    stack, now = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, by_path, sizes = stack[-1]
                    by_path[path] = verdict
                    if len(path) not in sizes:
                        bisect.insort(sizes, len(path), key=lambda n: -n)
                    continue
                best = None
                for _, domain, by_path, sizes in stack:
                    for n in sizes:
                        if path[:n] in by_path and len(path) >= n:
                            if best is None or len(domain) + n > best[0]:
                                best = (len(domain) + n, domain + path[:n], by_path[path[:n]])
                            break
                picked.append(i)
                hosts.append(host)
                paths.append(path)
                found.append(best[1] if best else None)
                verdicts.append(best[2] if best else default)
            if picked:
                ids = batch.column(4).take(pa.array(picked, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts)]], names=schema.names)

    return events.mapInArrow(sweep, schema).withColumnRenamed("id", id_col)
