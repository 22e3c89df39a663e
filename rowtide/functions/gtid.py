"""Transaction ids and their sets as Spark columns and frames.

A MySQL set is text such as ``uuid:1-4:7,uuid:1-8``; a MariaDB set is a list of ``domain-server-sequence``. Sets are
compared as rows of half-open ranges, so merging is a window over ranges and never a loop. A set counts as a whole: if any
part of it is malformed or tagged, none of it is used, and text or bytes made from it are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = (1 << 63) - 1


_SPACE = r"[ \t\n\r]+"


def _column(gtid: str | Column) -> Column:
    return F.col(gtid) if isinstance(gtid, str) else gtid


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def _listed(gtid: str | Column) -> Column:
    """The parts of a set between commas, without white space around them; empty ones don't count."""
    return F.filter(F.transform(F.split(_column(gtid), ","), _trimmed), lambda p: p != "")


def _behind(part: Column) -> Column:
    """What follows the first colon."""
    return F.regexp_extract(part, "(?s)^[^:]*:(.*)$", 1)


def normalized(gtid: str | Column) -> Column:
    """A single number stands for the range up to it: ``uuid:7`` becomes ``uuid:1-7``; ``uuid:0`` is left out. Whatever has a
    range, several numbers, a tag or no colon stays as it is, and so does white space around a set of one part."""
    g = _column(gtid)
    each = F.when(F.contains(g, F.lit(",")), _listed(g)).otherwise(F.array(g))
    each = F.filter(each, lambda p: ~(F.contains(p, F.lit(":")) & (_behind(p) == "0")))
    single = lambda p: F.contains(p, F.lit(":")) & ~_behind(p).rlike("[-:]")
    return F.when(g.isNotNull(), F.array_join(F.transform(each, lambda p: F.when(single(p), F.concat(F.substring_index(p, ":", 1), F.lit(":1-"), _behind(p))).otherwise(p)), ","))


def is_tagged(gtid: str | Column) -> Column:
    """Whether a part of a set has a letter behind its uuid."""
    return F.exists(_listed(gtid), lambda p: _behind(p).rlike("[A-Za-z]"))


def is_mariadb(gtid: str | Column) -> Column:
    """Whether every part is domain-server-sequence, of 32, 32 and 64 bits, and there is one; commas too many don't matter."""
    within = lambda x, bits: F.coalesce(x.try_cast("decimal(38,0)") < F.lit(str(1 << bits)).cast("decimal(38,0)"), F.lit(False))
    field = lambda p, k: F.regexp_extract(p, "^([0-9]+)-([0-9]+)-([0-9]+)$", k)
    parts = _listed(gtid)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: within(field(p, 1), 32) & within(field(p, 2), 32) & within(field(p, 3), 64))


def is_safe_mariadb(gtid: str | Column) -> Column:
    return _column(gtid).rlike("^[0-9, -]*$")


def _parts(gtid: str) -> Column:
    """The ranges of a MySQL set as an array of (sid, start, end), with nulls for all that doesn't parse."""
    blank = r"[ \t\n\r\x0b\f]*"

    def of_part(p: Column) -> Column:
        compact = F.lower(F.replace(F.substring_index(p, ":", 1), F.lit("-")))
        good = F.contains(p, F.lit(":")) & (F.length(F.substring_index(p, ":", 1)) == 36) & compact.rlike("^[0-9a-f]{32}$")
        sid = F.concat_ws("-", *[F.substring(compact, x, n) for x, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        pieces = F.filter(F.split(_behind(p), ":"), lambda x: x != "")
        pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("none")))

        def of_piece(x: Column) -> Column:
            x = _trimmed(x)
            number = lambda pattern: F.regexp_extract(x, pattern, 1).try_cast("decimal(38,0)")
            start = number(rf"^{blank}\+?([0-9]+)(-{blank}\+?[0-9]+)?$")
            to = F.coalesce(number(rf"^{blank}\+?[0-9]+-{blank}\+?([0-9]+)$"), start)
            fits = good & (start >= 1) & (to >= start) & (to < LIMIT)
            return F.struct(F.when(fits, sid).alias("sid"), F.when(fits, start).cast("long").alias("start"), F.when(fits, to + 1).cast("long").alias("end"))

        return F.transform(pieces, of_piece)

    return F.flatten(F.transform(_listed(gtid), of_part))


def ranges(sets: DataFrame, gtid: str, *keep: str) -> DataFrame:
    """Rows (keep..., sid, start, end) of MySQL sets, half-open; a set of which any part doesn't parse gives one row of nulls.

    A part is ``uuid`` of 32 hexadecimal digits in 36 characters, then numbers or ranges from 1 on; tagged parts don't parse.
    Colons too many don't matter. An empty set gives no row.
    """
    none = F.array(F.struct(F.lit(None).cast("string").alias("sid"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))
    found = sets.select(*keep, _parts(gtid).alias("__parts"))
    whole = F.when(F.exists("__parts", lambda x: x["sid"].isNull()), none).otherwise(F.col("__parts"))
    return found.select(*keep, F.explode(whole).alias("__x")).select(*keep, "__x.*")


def islands(found: DataFrame, by: list[str]) -> DataFrame:
    """As ``merged``, for few ranges of each key, which one task lines up."""
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max("end").over(before)
    found = found.withColumn("__new", F.when(top.isNull() | (F.col("start") > top), 1).otherwise(0))
    found = found.withColumn("__island", F.sum("__new").over(upto))
    return found.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def merged(found: DataFrame, *by: str) -> DataFrame:
    """Ranges (by..., start, end) with overlapping and adjacent ones joined.

    A log has one or two server ids, so ranges are first joined within stretches of 2^20 numbers, all at once, and only
    what is left of each stretch is lined up by itself.
    """
    first = islands(found.withColumn("__stretch", F.shiftright("start", 20)), [*by, "__stretch"]).drop("__stretch")
    return islands(first, list(by))


def set_text(found: DataFrame, *by: str) -> DataFrame:
    """(by..., gtid_set): the canonical text of merged ranges (by..., sid, start, end); null where one is null."""
    one = F.when(F.col("end") - F.col("start") == 1, F.col("start").cast("string")).otherwise(F.concat(F.col("start").cast("string"), F.lit("-"), (F.col("end") - 1).cast("string")))
    listed = found.groupBy(*by, "sid").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("text")))).alias("parts"))
    sid = F.concat(F.col("sid"), F.lit(":"), F.array_join(F.transform("parts", lambda p: p["text"]), ":"))
    return listed.groupBy(*by).agg(F.when(F.count("sid") == F.count("*"), F.array_join(F.array_sort(F.collect_list(sid)), ",")).alias("gtid_set"))


def _le8(n: Column) -> Column:
    """Eight little-endian bytes as hexadecimal text."""
    h = F.lpad(F.lower(F.hex(n)), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])


def encoded(found: DataFrame, *by: str) -> DataFrame:
    """(by..., encoded): merged ranges in the binary form of the wire, as hexadecimal text; null where one is null."""
    listed = found.groupBy(*by, "sid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    one = F.concat(F.replace("sid", F.lit("-")), _le8(F.size("parts").cast("long")), F.array_join(F.transform("parts", lambda p: F.concat(_le8(p["start"]), _le8(p["end"]))), ""))
    whole = F.concat(_le8(F.count("*")), F.array_join(F.array_sort(F.collect_list(one)), ""))
    return listed.groupBy(*by).agg(F.when(F.count("sid") == F.count("*"), whole).alias("encoded"))


def encoded_sets(sets: DataFrame, gtid: str, *key: str) -> DataFrame:
    """(key..., encoded) of MySQL sets as text, a row for each key: an empty set has the form of one; null where a part doesn't parse."""
    some = encoded(merged(ranges(sets, gtid, *key), *key, "sid"), *key)
    none = F.when(F.size(_listed(gtid)) == 0, F.lit("0" * 16))
    return sets.select(*key, none.alias("__none")).join(some, list(key), "left").select(*key, F.coalesce("encoded", "__none").alias("encoded"))


def missing(whole: DataFrame, part: DataFrame, *by: str) -> DataFrame:
    """The merged ranges of ``part`` (by..., sid, start, end) that no range of ``whole`` holds."""
    w = whole.select(*by, "sid", F.col("start").alias("ws"), F.col("end").alias("we"))
    same = [F.col(f"p.{c}") == F.col(f"w.{c}") for c in (*by, "sid")]
    return part.alias("p").join(w.alias("w"), [*same, F.col("ws") <= F.col("p.start"), F.col("we") >= F.col("p.end")], "left_anti")


def mariadb_parts(sets: DataFrame, gtid: str, *keep: str) -> DataFrame:
    """Rows (keep..., domain, server, seq) of MariaDB sets; a set of which any part doesn't parse gives one row of nulls."""
    parts = F.when(is_mariadb(gtid) | (F.size(_listed(gtid)) == 0), _listed(gtid)).otherwise(F.array(F.lit(None).cast("string")))
    part = sets.filter(F.col(gtid).isNotNull()).select(*keep, F.explode(parts).alias("part"))
    field = lambda k: F.regexp_extract("part", "^([0-9]+)-([0-9]+)-([0-9]+)$", k).try_cast("decimal(20,0)")
    return part.select(*keep, field(1).cast("long").alias("domain"), field(2).cast("long").alias("server"), field(3).alias("seq"))


def high_water(found: DataFrame, *by: str) -> DataFrame:
    """Of each domain the row with the greatest sequence; rows of sets that don't parse tell nothing."""
    return found.filter("domain is not null").groupBy(*by, "domain").agg(F.max_by("server", "seq").alias("server"), F.max("seq").alias("seq"))
