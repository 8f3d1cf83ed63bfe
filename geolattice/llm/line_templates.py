"""Line dedup (operator 9): a log-template tree, in DataFrame functions only.

Lines go down a tree of fixed depth: by their number of tokens, then by their leading tokens, where tokens with digits
are variable fields. In a leaf, a position of a line stays constant if enough lines of the leaf have its token there;
else it is a variable field as well. Lines that come out alike have a template in common. A template that recurs in
many documents is dropped from all of them.

Copies of a document, and near copies of it, repeat most of its lines, and they are no matter of this step. So a
template's texts are counted by how much of them is their own: the share of their tokens in lines of leaves that few
texts have. A template is dropped if it stands in enough texts of which half is their own; or else, as a menu on short
pages does, in enough texts of which an eighth is their own, if most of its texts are like that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Leading tokens that choose a leaf.
DEPTH = 3
#: Different texts that make a leaf common, a token of it constant, or a template recurrent.
RECURS = 8
#: A text is its own document for certain from a half on, and perhaps from an eighth on: then three quarters of the
#: template's texts must be so. (One part in HALF, one in SOME, MOST[0] of MOST[1].)
HALF, SOME, MOST = 2, 8, (3, 4)
#: Share of tokens that must be constant, else a line is a template of its own.
CONSTANT = 0.7
#: Keys up to which a set is sent to all executors (16 bytes each); beyond, it is joined by a shuffle.
SENDABLE = 200_000
FIELD = "<*>"
_SPACE = r"[ \t\r\f\x0B]+"


def _number(text: Column) -> Column:
    """60 bits of the MD5, which any SQL engine has."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r\f\x0b")), _SPACE)


def _mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), FIELD).otherwise(token)


def _leaf(tokens: Column) -> Column:
    """Null for a line without tokens."""
    leading = F.array_join(F.transform(F.slice(tokens, 1, DEPTH), _mask), " ")
    return F.when(tokens[0] != "", _number(F.concat_ws(" ", F.size(tokens).cast("string"), leading)))


def _leaves(lines: Column) -> Column:
    """The leaf of each line. Lines are cut into tokens by a step of its own, so that this is done once."""
    return F.transform(F.transform(lines, _tokens), _leaf)


def _key(docs: DataFrame) -> Column:
    """Tells rows apart; rows with the same id and text have the same lines dropped anyway."""
    return F.xxhash64("doc_id", "text").alias("key")


def _occurrences(docs: DataFrame) -> DataFrame:
    """key, body (hash of the text), size (tokens of the text), at, tokens, leaf, of every line that has tokens."""
    cut = docs.select(_key(docs), F.xxhash64("text").alias("body"), F.transform(F.split("text", "\n"), _tokens).alias("lines"))
    sized = cut.withColumn("size", F.aggregate("lines", F.lit(0).cast("long"), lambda n, t: n + F.when(t[0] != "", F.size(t)).otherwise(0)))
    each = sized.select("key", "body", "size", F.posexplode("lines").alias("at", "tokens"))
    return each.withColumn("leaf", _leaf(F.col("tokens"))).where("leaf is not null")


def _sent(keys: DataFrame, count: int) -> DataFrame:
    return F.broadcast(keys) if count <= SENDABLE else keys


def dropped_lines(docs: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """key, at (array of positions from 0): the lines of each document whose template recurs."""
    leaves = docs.select(F.xxhash64("text").alias("body"), F.explode(_leaves(F.split("text", "\n"))).alias("leaf")).where("leaf is not null").distinct()
    busy = common.materialise(leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECURS).select("leaf"), "line-leaves", held)
    inside = _occurrences(docs).join(_sent(busy, busy.count()), "leaf")
    masked = inside.withColumn("tokens", F.transform("tokens", _mask)).withColumn("shape", F.xxhash64(F.array_join("tokens", " ")))
    lines = common.materialise(masked, "line-candidates", held)

    shapes = lines.groupBy("leaf", "shape").agg(F.count(F.lit(1)).alias("n"), F.any_value("tokens").alias("tokens"))
    placed = common.materialise(shapes.select("leaf", "shape", "n", F.posexplode("tokens").alias("place", "token")), "line-tokens", held)
    support = placed.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support"))
    fixed = support.where(F.col("support") >= RECURS).select("leaf", "place", "token", F.lit(True).alias("fixed"))
    settled = placed.join(fixed, ["leaf", "place", "token"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)) & (F.col("token") != FIELD))
    part = F.xxhash64("place", F.when(F.col("fixed"), F.col("token")).otherwise(FIELD))
    merged = settled.groupBy("leaf", "shape").agg(F.bit_xor(part).alias("mixed"), F.avg(F.col("fixed").cast("int")).alias("share"))
    # Two templates of a leaf are alike if all their places are; a line with too few constants stays itself.
    template = F.when(F.col("share") >= CONSTANT, F.xxhash64(F.lit("t"), "leaf", "mixed")).otherwise(F.xxhash64(F.lit("s"), "leaf", "shape"))
    templates = common.materialise(merged.select("leaf", "shape", template.alias("template")), "line-templates", held)

    # What a text shares, with each of its lines once, however many rows have that text.
    once = lines.groupBy("body", "at").agg(F.any_value("size").alias("size"), F.any_value(F.size("tokens")).alias("n"))
    own = once.groupBy("body").agg(F.any_value("size").alias("size"), F.sum("n").alias("shared")).select("body", (F.col("size") - F.col("shared")).alias("own"), "size")
    seen = lines.select("leaf", "shape", "body").join(templates, ["leaf", "shape"]).select("template", "body").distinct().join(own, "body")
    numbers = seen.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), *(F.count_if(F.col("own") * part >= F.col("size")).alias(name) for name, part in (("half", HALF), ("some", SOME))))
    few = (F.col("some") >= RECURS) & (F.col("some") * MOST[1] >= F.col("texts") * MOST[0])
    recurrent = numbers.where((F.col("half") >= RECURS) | few).select("template")
    bad = common.materialise(templates.join(recurrent, "template").select("leaf", "shape"), "line-recurrent", held)
    hit = lines.select("key", "at", "leaf", "shape").join(_sent(bad, bad.count()), ["leaf", "shape"])
    return hit.groupBy("key").agg(F.collect_set("at").alias("at"))


def drop_recurrent_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurrent lines left out of ``text``, and n_chars (if there) made to fit; n_dropped is added.

    Lines are parted by \\n, tokens by other ASCII white space; lines without tokens stay. A null text stays null and
    an empty one empty; a text of recurrent lines only becomes empty; no row goes. Equal texts count as one,
    and are cut alike. Further columns are kept as they are. An empty table gives an empty result.
    """
    held: list[DataFrame] = []
    cut = common.materialise(dropped_lines(docs.select("doc_id", "text"), held), "line-dropped")
    common.discard_all(held)
    # The same join at every size: what is cut grows with the documents.
    joined = docs.withColumn("__key", _key(docs)).join(cut.select(F.col("key").alias("__key"), F.col("at").alias("__at")).hint("merge"), "__key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("__at", at)), "\n")
    changed = F.col("__at").isNotNull()
    out = joined.withColumn("__kept", F.when(changed, kept).otherwise(F.col("text")))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__kept").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length("__kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        elif c != "n_dropped":
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns, F.coalesce(F.array_size("__at"), F.lit(0)).cast("long").alias("n_dropped"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_recurrent_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, text, p - 1 AS spot, string_split(text, chr(10))[p] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p FROM documents WHERE text IS NOT NULL)
), t AS (
  SELECT doc_id, text, spot, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN regexp_split_to_array(line, '[ \t\r\f\x0B]+') IF x <> ''] AS tokens FROM l
), f AS (
  SELECT doc_id, text, spot, tokens, array_to_string(tokens, ' ') AS shape,
         CAST('0x' || substr(md5(len(tokens) || ' ' || array_to_string(tokens[1:3], ' ')), 1, 15) AS BIGINT) AS leaf
  FROM t WHERE len(tokens) > 0
), c AS (
  SELECT * FROM f WHERE leaf IN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT text) >= 8)
), ownness AS (
  SELECT text, sum(n) AS size, sum(CASE WHEN leaf IN (SELECT leaf FROM c) THEN 0 ELSE n END) AS own FROM (SELECT DISTINCT text, spot, len(tokens) AS n, leaf FROM f) GROUP BY 1
), s AS (
  SELECT leaf, shape, count(*) AS n, any_value(tokens) AS tokens FROM c GROUP BY 1, 2
), p AS (
  SELECT leaf, shape, n, unnest(generate_series(1, len(tokens))) AS place, unnest(tokens) AS token FROM s
), u AS (
  SELECT leaf, place, token FROM p GROUP BY 1, 2, 3 HAVING sum(n) >= 8
), g AS (
  SELECT p.leaf, p.shape, p.place, CASE WHEN u.leaf IS NOT NULL AND p.token <> '<*>' THEN p.token END AS constant
  FROM p LEFT JOIN u ON p.leaf = u.leaf AND p.place = u.place AND p.token = u.token
), m AS (
  SELECT leaf, shape, CASE WHEN count(constant) >= 0.7 * count(*) THEN 't ' || string_agg(coalesce(constant, '<*>'), ' ' ORDER BY place) ELSE 's ' || shape END AS template FROM g GROUP BY 1, 2
), x AS (
  SELECT DISTINCT c.leaf, m.template, c.text FROM c JOIN m ON c.leaf = m.leaf AND c.shape = m.shape
), r AS (
  SELECT leaf, template, count(*) AS texts, count(*) FILTER (own >= 0.5 * size) AS half, count(*) FILTER (own >= 0.125 * size) AS eighth
  FROM x JOIN ownness ON x.text = ownness.text GROUP BY 1, 2
), bad AS (
  SELECT m.leaf, m.shape FROM m JOIN r ON m.leaf = r.leaf AND m.template = r.template WHERE half >= 8 OR (eighth >= 8 AND eighth >= 0.75 * texts)
), d AS (
  SELECT DISTINCT doc_id, text, spot FROM c JOIN bad ON c.leaf = bad.leaf AND c.shape = bad.shape
), k AS (
  SELECT l.doc_id, l.text, count(d.spot) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.spot) FILTER (d.spot IS NULL), '') AS kept
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.text = d.text AND l.spot = d.spot GROUP BY 1, 2
)
SELECT doc_id, n_dropped, length(kept) AS n_chars, sha256(kept) AS text_sha256 FROM k
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
