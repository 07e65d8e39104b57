"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.llm.canonical import Spelling, map_values
from strideflow.llm.entities import match_roads
from strideflow.llm.groups import link_groups
from strideflow.llm.leaks import leaks
from strideflow.llm.mixing import mix, shares_reached
from strideflow.llm.pieces import pieces
from strideflow.llm.quantiles import runs, select
from strideflow.llm.terms import marked, term_counts
from strideflow.operators.packed import cut_fields, known_values
from strideflow.queries.data import PIECES_SQL
from strideflow.sources.tables import read_table

MEASURES = ["length_m", "demand"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link with the smallest link of its group."""
    return link_groups(read_table(spark, sf_dir, "links", ["link_id", "u", "v"]))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trip once: re-deliveries repeat a trip unchanged but for the time of loading."""
    t = read_table(spark, sf_dir, "trip_lengths", ["trip_id", "origin", "run_date", *MEASURES])
    return t.groupBy("trip_id").agg(*[F.first(c).alias(c) for c in ("origin", "run_date", *MEASURES)])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins whose 95th percentile is over six times the median."""
    p = select(runs(_trips(spark, sf_dir), "origin", MEASURES), [0.5, 0.95], least=40)
    both = p.groupBy("grp", "measure").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    return both.where("p95 > 6 * p50").select(F.col("grp").alias("origin"), "measure")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, 5th and 95th percentile per origin and measure; exact."""
    p = select(runs(_trips(spark, sf_dir), "origin", MEASURES), [0.05, 0.25, 0.5, 0.75, 0.95])
    return p.select(F.col("grp").alias("origin"), "measure", "q", "n", F.round("value", 6).alias("value"))


#: Classes of the other network by the link's first highway value; other values carry no motor traffic.
MOTOR_CLASS = {
    "motorway": 1, "motorway_link": 1, "trunk": 1, "trunk_link": 1, "primary": 1, "primary_link": 1, "secondary": 2, "secondary_link": 2, "tertiary": 3,
    "tertiary_link": 3, "unclassified": 4, "road": 4, "residential": 5, "living_street": 6, "service": 6,
}


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_row, source_row, offset_m, confidence) of every pair that belongs together; re-delivered rows of a link share its matches."""
    links = read_table(spark, sf_dir, "links", ["link_row", "link_id", "highway", "street_name", "geometry"])
    known = F.create_map(*[F.lit(x) for kv in MOTOR_CLASS.items() for x in kv])
    first = F.regexp_extract(F.lower("highway"), r"([a-z]+(?:_[a-z]+)*)", 1)
    once = links.groupBy("link_id").agg(F.min_by(F.struct("highway", "street_name", "geometry"), F.when(F.col("geometry").isNotNull(), F.col("link_row"))).alias("r")).select(F.col("link_id").alias("link"), "r.*")
    motor = once.withColumn("road_class", F.try_element_at(known, first)).where("road_class is not null").withColumnRenamed("street_name", "name")
    lines = read_table(spark, sf_dir, "volumes", ["source_row", "road_class", "road_name", "geometry"]).select(F.col("source_row").alias("line"), F.col("road_name").alias("name"), "road_class", "geometry")
    found = match_roads(motor, lines).where("belief > 0")
    return links.select("link_row", "link_id").join(found, F.col("link_id") == F.col("link")).select("link_row", F.col("line").alias("source_row"), "offset_m", "confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link row and volume line that stand for the same road along the whole link."""
    return _roads(spark, sf_dir).select("link_row", "source_row").distinct()


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their offset and confidence, and the cars an hour that the line gives the link."""
    lines = read_table(spark, sf_dir, "volumes", ["source_row", "volume"])
    return _roads(spark, sf_dir).join(lines, "source_row").select("link_row", "source_row", F.round("offset_m", 2).alias("offset_m"), F.round("confidence", 4).alias("confidence"), F.round(F.col("volume") / 14, 3).alias("cars_per_hour"))


#: How counters are typed, on folded text.
COUNTERS = Spelling(
    noise=(r"\blam \d+\b", r"#\d+", r"\(pyorat\)", r"\b2-suunt\b\.?", r"-\s*vanha\b", r"\blaskuri\b", r"pp\W*$", r"\bpp\b"),
    endings=(("katu", ("k",)), ("tie", ("t",)), ("polku", ("p",)), ("silta", ("s",)), ("raitti", ("r",)), ("bulevardi", ("bul", "b")), ("kuja", ("kj", "k")), ("vayla", ("vl", "v"))),
    additions=("etela", "pohjoinen", "ita", "lansi", "alapaa", "ylapaa", "alikulku", "ylikulku", "rantareitti"),
)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read_table(spark, sf_dir, "observed", ["obs_id", "city", "counter_name", "x", "y"])
    mid = lambda c: (F.element_at("geometry", 1)[c] + F.element_at("geometry", -1)[c]) / 2
    lines = read_table(spark, sf_dir, "count_lines").select("line_id", F.col("city").alias("line_city"), "counter", mid("x").alias("lx"), mid("y").alias("ly"))
    return map_values(seen, "obs_id", "city", "counter_name", "x", "y", lines, "line_id", "line_city", "counter", "lx", "ly", COUNTERS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter that each observation's typed name means, or -1."""
    return _mapped(spark, sf_dir)


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names that mean no counter, with their observations."""
    seen = read_table(spark, sf_dir, "observed", ["obs_id", "counter_name"]).distinct()
    return _mapped(spark, sf_dir).where("line_id = -1").join(seen, "obs_id").groupBy("counter_name").agg(F.count("*").alias("observations"))


def _values(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    """Distinct fields of ``links`` with their number of rows, cut into lower-case values."""
    links = read_table(spark, sf_dir, "links", fields)
    words = known_values(links, fields)
    cells = links.select(F.explode(F.array(*[F.struct(F.lit(f).alias("tag_field"), F.col(f).alias("raw")) for f in fields])).alias("c")).select("c.tag_field", "c.raw")
    counted = cells.where("raw is not null").groupBy("tag_field", "raw").agg(F.count("*").alias("key"))
    return cut_fields(counted, words).select("tag_field", F.transform("items", F.lower).alias("terms"), F.col("key").alias("weight")).where(F.size("terms") > 0)


def _counted(spark: SparkSession, sf_dir: str, max_n: int | None = None) -> DataFrame:
    """Marked counts of all sequences of values that the fields hold, or of up to ``max_n`` values."""
    values = _values(spark, sf_dir, ["highway", "surface"])
    sizes = values.groupBy(F.col("tag_field").alias("grp")).agg(F.sum("weight").alias("total"))
    return marked(term_counts(values, "terms", "tag_field", "weight", max_n), sizes)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two tags that are too rare or too common to be useful."""
    return _counted(spark, sf_dir).where("n = 1 and mark is not null").select(F.col("grp").alias("tag_field"), F.element_at("term", 1).alias("term"), "mark")


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and link rows of every sequence of up to three values within a field."""
    return _counted(spark, sf_dir, 3).select(F.col("grp").alias("tag_field"), F.array_join("term", " > ").alias("term"), "n", "tf", "df", F.coalesce("mark", F.lit("")).alias("mark"))


def p7_all_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every sequence, however long."""
    return _counted(spark, sf_dir).select(F.col("grp").alias("tag_field"), F.array_join("term", " > ").alias("term"), "n", "tf", "df", F.coalesce("mark", F.lit("")).alias("mark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least two fifths of an evaluation item in one stretch."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return leaks(docs, read_table(spark, sf_dir, "eval_items", ["item_id", "text"])).select("item_id", "doc_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaked item the number of documents and its longest stretch as a share of its words."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = leaks(docs, read_table(spark, sf_dir, "eval_items", ["item_id", "text"]))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max(F.round(F.col("words") / F.col("item_words"), 3)).alias("longest_share"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the largest mix with the target shares, each with its number of uses."""
    return mix(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), read_table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return shares_reached(p9_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 512 tokens, 64 of them overlapping, of every longer document."""
    return pieces(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), limit=512, overlap=64)


_TRIPS = "trips AS (SELECT DISTINCT trip_id, origin, length_m, demand FROM trip_lengths), vals AS (SELECT origin, 'length_m' AS measure, length_m AS v FROM trips WHERE length_m IS NOT NULL AND NOT isnan(length_m) UNION ALL SELECT origin, 'demand', demand FROM trips WHERE demand IS NOT NULL AND NOT isnan(demand))"
_VALUES = f"{PIECES_SQL.strip()}, recs AS (SELECT tag_field, link_row, list_transform(items, lambda x: lower(x)) AS terms FROM pieces WHERE len(items) > 0 AND tag_field <> 'crossing'), sizes AS (SELECT tag_field, count(*) AS total FROM recs GROUP BY 1)"
_GRAMS = "grams AS (" + " UNION ALL ".join(f"SELECT tag_field, link_row, array_to_string(terms[i:i + {n - 1}], ' > ') AS term, {n} AS n FROM recs, LATERAL (SELECT unnest(range(1, len(terms) + {2 - n})) AS i)" for n in (1, 2, 3)) + ")"
_ALL_GRAMS = "grams AS (SELECT tag_field, link_row, array_to_string(terms[i:j], ' > ') AS term, j - i + 1 AS n FROM (SELECT *, unnest(range(i, len(terms) + 1)) AS j FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM recs)))"
_MARK = "CASE WHEN count(DISTINCT link_row) <= 3 THEN 'rare' WHEN count(DISTINCT link_row) > 0.25 * any_value(total) THEN 'common' ELSE '' END"

QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p1_found": p1_found, "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p7_found": p7_found, "p7_sequences": p7_sequences, "p7_all_sequences": p7_all_sequences, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_report": p9_report, "p10_pieces": p10_pieces}
SQL = {
    "p1_found": "WITH RECURSIVE ends AS (SELECT link_id, e FROM (SELECT link_id, unnest([u, v]) AS e FROM links WHERE link_id IS NOT NULL) WHERE e <> 0), pairs AS (SELECT DISTINCT a.e AS a, b.e AS b FROM ends a JOIN ends b USING (link_id)), reach(a, b) AS (SELECT e, e FROM ends UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b), root AS (SELECT a AS e, min(b) AS root FROM reach GROUP BY 1), grp AS (SELECT root, min(link_id) AS group_id FROM ends JOIN root USING (e) GROUP BY 1) SELECT DISTINCT l.link_id, coalesce(g.group_id, l.link_id) AS group_id FROM (SELECT DISTINCT link_id FROM links WHERE link_id IS NOT NULL) l LEFT JOIN (SELECT DISTINCT link_id, root FROM ends JOIN root USING (e)) r USING (link_id) LEFT JOIN grp g USING (root)",
    "p4_found": f"WITH {_TRIPS} SELECT origin, measure FROM vals GROUP BY ALL HAVING count(*) >= 40 AND quantile_cont(v, 0.95) > 6 * quantile_cont(v, 0.5)",
    "p4_percentiles": f"WITH {_TRIPS} SELECT origin, measure, CAST(q AS DOUBLE) AS q, n, round(value, 6) AS value FROM (SELECT origin, measure, n, unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q, unnest(a) AS value FROM (SELECT origin, measure, count(*) AS n, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS a FROM vals GROUP BY ALL))",
    "p7_found": f"WITH {_VALUES}, {_GRAMS}, marks AS (SELECT tag_field, term, {_MARK} AS mark FROM grams JOIN sizes USING (tag_field) WHERE n = 1 GROUP BY ALL) SELECT tag_field, term, mark FROM marks WHERE mark <> ''",
    "p7_sequences": f"WITH {_VALUES}, {_GRAMS} SELECT tag_field, term, CAST(n AS INTEGER) AS n, count(*) AS tf, count(DISTINCT link_row) AS df, {_MARK} AS mark FROM grams JOIN sizes USING (tag_field) GROUP BY tag_field, term, n",
    "p7_all_sequences": f"WITH {_VALUES}, {_ALL_GRAMS} SELECT tag_field, term, CAST(n AS INTEGER) AS n, count(*) AS tf, count(DISTINCT link_row) AS df, {_MARK} AS mark FROM grams JOIN sizes USING (tag_field) GROUP BY tag_field, term, n",
}
