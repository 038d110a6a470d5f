"""Merkle fixity audit of WARC replicas (operator 7).

Each record is hashed; the ordered records of the primary's file, FAN on end, are a range of
its offsets, FAN neighbouring ranges the range above, and so on up to one root. The primary's
ranges are the manifest: a replica's record belongs to the range in which its id falls, so
that a lost record moves none of the others. Two replicas are compared from their roots down,
and only branches that differ are followed, to the records that are damaged, missing or extra
and to their byte offsets.

A node's digest is the hash of the number of its children and of four sums, in 60 bits each,
of the hashes of their keys, lengths and digests. Sums are combined before they are shuffled:
no task gathers the children of a node, the records of one id, or a replica's surplus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.shared import materialise, table

FAN = 256
#: Records that are put in order together; a file of more is cut to ranges of ids first.
CELL = 1_000_000
LANES = 4
NO_ID = -(2**63)
REPLICA, PRIMARY = 0, 1


def warc_record(url: Column, html: Column) -> Column:
    """A response record; a null url or page is an empty one."""
    url, html = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def _sums(digest: str) -> list[Column]:
    return [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(LANES)]


def _combined() -> Column:
    return F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(LANES)]), 256).alias("digest")


def leaves(pages: DataFrame) -> DataFrame:
    """(node, digest, length): records by id; records of one id are one leaf."""
    each = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("node"), warc_record(F.col("url"), F.col("html")).alias("record"))
    hashed = each.select("node", F.sha2("record", 256).alias("item"), F.octet_length("record").cast("long").alias("length"))
    return hashed.groupBy("node").agg(F.count("*").alias("n"), F.sum("length").alias("length"), *_sums("item")).select("node", _combined(), "length")


def placed(ours: DataFrame, theirs: DataFrame, cell: int = CELL) -> DataFrame:
    """(side, node, digest, length, up, offset) of all leaves: the range that each falls in, and the offset in the primary's file.

    Ids are cut to cells of about cell leaves; what lies before a cell is summed up by cells,
    so that no task orders more than a cell.
    """
    both = materialise(ours.select(F.lit(PRIMARY).alias("side"), "*").union(theirs.select(F.lit(REPLICA).alias("side"), "*")))
    cells = both.count() // cell + 1
    cut = materialise(both.repartitionByRange(cells, "node").withColumn("cell", F.spark_partition_id()))
    own = F.when(F.col("side") == PRIMARY, 1).otherwise(0)
    totals = cut.groupBy("cell").agg(F.sum(own).alias("n"), F.sum(own * F.col("length")).alias("bytes"))
    # A row a cell, in one task: a file of 10 ** 11 records has 100,000.
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"))
    # The replica's leaf comes before the primary's of the same id.
    order = Window.partitionBy("cell").orderBy("node", "side")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    twin = (F.col("side") == PRIMARY) | F.coalesce(F.lead("node").over(order) == F.col("node"), F.lit(False))
    inside = cut.select("*", F.coalesce(F.sum(own).over(before), F.lit(0)).alias("k"), F.coalesce(F.sum(own * F.col("length")).over(before), F.lit(0)).alias("start"), twin.alias("twin"))
    known = inside.join(F.broadcast(bases), "cell").withColumn("rank", F.col("n0") + F.col("k"))
    rank = F.when(F.col("twin"), F.col("rank")).otherwise(F.greatest(F.col("rank") - 1, F.lit(0)))
    return known.select("side", "node", "digest", "length", F.floor(rank / FAN).cast("long").alias("up"), (F.col("bytes0") + F.col("start")).cast("long").alias("offset"))


def above(nodes: DataFrame) -> DataFrame:
    """The ranges (side, node, digest, length, offset) over nodes, which tell theirs as up."""
    items = nodes.select("side", "up", "length", F.when(F.col("side") == PRIMARY, F.col("offset")).alias("offset"), F.sha2(F.concat_ws(":", F.col("node").cast("string"), F.col("length").cast("string"), "digest"), 256).alias("item"))
    return items.groupBy("side", "up").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.min("offset").alias("offset"), *_sums("item")).select("side", F.col("up").alias("node"), _combined(), "length", "offset")


def _over(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("up", F.floor(F.col("node") / FAN).cast("long"))


def trees(primary: DataFrame, replica: DataFrame, cell: int = CELL) -> list[DataFrame]:
    """Nodes of both sides by level, the leaves first and the root last. Pages are read once; depth follows from their number."""
    levels = [materialise(placed(leaves(primary), leaves(replica), cell))]
    ranges = -(-levels[0].where(F.col("side") == PRIMARY).count() // FAN)
    levels.append(materialise(_over(above(levels[0]))))
    while ranges > 1:
        ranges = -(-ranges // FAN)
        levels.append(materialise(_over(above(levels[-1]))))
    return levels


def audit(primary: DataFrame, replica: DataFrame, cell: int = CELL) -> DataFrame:
    """(level, node, status, offset, length, digest, replica_digest) of every node that differs.

    level 0 has the records, node is then the record's id; above it node is the number of the
    range, and the last level has the root alone. offset and length are of the primary's file,
    whose records stand by id; an extra node has the offset where it would stand. status is
    'differs', 'missing' or 'extra', as seen from the primary. Equal replicas give no rows, as
    do two empty ones; if one is empty, all nodes of the other are told. A null page_id counts
    as the least id, null urls and pages as empty ones. Repeated rows and other records of one
    id are one leaf, whatever their order. Very long pages are hashed whole. Columns besides
    page_id, url and html are not read.
    """
    levels = trees(primary, replica, cell)
    follow = found = None
    for level in range(len(levels) - 1, -1, -1):
        here = levels[level] if follow is None else levels[level].join(follow, "up", "left_semi")
        a, b = here.where(F.col("side") == PRIMARY), here.where(F.col("side") == REPLICA)
        pairs = a.select("node", "offset", "length", "digest").join(b.select("node", F.col("offset").alias("there"), F.col("digest").alias("replica_digest")), "node", "full_outer")
        differ = materialise(pairs.where(~F.col("digest").eqNullSafe(F.col("replica_digest"))))
        status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("differs")
        rows = differ.select(F.lit(level).alias("level"), "node", status.alias("status"), F.coalesce("offset", "there", F.lit(0)).cast("long").alias("offset"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), "digest", "replica_digest")
        found = rows if found is None else found.union(rows)
        follow = differ.select(F.col("node").alias("up"))
    return found


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with simulated damage: by the MD5 of the url 1 page in 128 has lost its second half, and 1 in 1,024 is missing."""
    draw = F.md5(F.coalesce(F.col("url"), F.lit("")))
    half = F.expr("left(html, CAST(length(html) DIV 2 AS INT))")
    return pages.where(~F.substring(draw, 1, 3).isin("000", "100", "200", "300")).withColumn("html", F.when(F.substring(draw, 1, 2).isin("44", "55"), half).otherwise(F.col("html")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


def _sql(deepest: int = 4) -> str:
    """All nodes that differ, level by level, up to the first that has one node alone."""
    record = "'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Length: ' || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n'"
    sums = ", ".join(f"sum(('0x' || substr(item, {1 + 15 * k}, 15))::bigint) s{k}" for k in range(LANES))
    combined = "sha256(concat_ws(':', n, " + ", ".join(f"s{k}" for k in range(LANES)) + "))"
    out = [
        f"""damaged as (
  select page_id, url, case when substr(md5(coalesce(url, '')), 1, 2) in ('44', '55') then left(html, (length(html) // 2)::int) else html end html
  from pages where substr(md5(coalesce(url, '')), 1, 3) not in ('000', '100', '200', '300')),
records as (
  select {PRIMARY} side, coalesce(page_id, {NO_ID}) node, sha256({record}) item, strlen({record}) length from pages
  union all select {REPLICA}, coalesce(page_id, {NO_ID}), sha256({record}), strlen({record}) from damaged),
leaf as (select side, node, sum(length)::bigint length, {combined} digest from (select side, node, count(*) n, sum(length) length, {sums} from records group by side, node) group by all),
walk as (
  select *, coalesce(sum(side) over w, 0) k, (coalesce(sum(side * length) over w, 0))::bigint "offset", side = {PRIMARY} or coalesce(lead(node) over (order by node, side) = node, false) twin
  from leaf window w as (order by node, side rows between unbounded preceding and 1 preceding)),
l0 as (select side, node, digest, length, "offset", (case when twin then k else greatest(k - 1, 0) end // {FAN})::bigint up from walk)"""
    ]
    for level in range(1, deepest + 1):
        out.append(f"""l{level} as (
  select side, up node, {combined} digest, length, "offset", up // {FAN} up
  from (select side, up, count(*) n, sum(length)::bigint length, min(case when side = {PRIMARY} then "offset" end) "offset", {sums}
    from (select *, sha256(concat_ws(':', node, length, digest)) item from l{level - 1}) group by side, up))""")
    rows = " union all ".join(f"""select {level} "level", coalesce(a.node, b.node) node, case when b.digest is null then 'missing' when a.digest is null then 'extra' else 'differs' end status, coalesce(a."offset", b."offset", 0)::bigint "offset", coalesce(a.length, 0)::bigint length, a.digest, b.digest replica_digest
  from (select * from l{level} where side = {PRIMARY}) a full join (select * from l{level} where side = {REPLICA}) b on a.node = b.node
  where a.digest is distinct from b.digest{f' and (select count(*) from l{level - 1} where side = {PRIMARY}) > 1' if level > 1 else ''}""" for level in range(deepest + 1))
    return "with " + ",\n".join(out) + "\n" + rows


QUERIES = {"op7_warc_fixity": op7}
SQL = {"op7_warc_fixity": _sql()}
