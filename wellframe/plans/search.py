"""Text, vectors, ids and units on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.functions import text as tx
from wellframe.functions import fuzzy, units
from wellframe.operators import indexing, textindex
from wellframe.operators.stages import dealt
from wellframe.plans.registry import Tables, query
from wellframe.streaming import changes

def _r(col, digits: int = 6):
    return F.round(col, digits)


def _vector0(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)


@query("fn12_cosine_topk", """
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], q), 6) AS d FROM embeddings, q ORDER BY list_cosine_distance(embedding::DOUBLE[], q), vec_id LIMIT 50""")
def cosine_topk(t: Tables) -> DataFrame:
    """FN-12, TK-02: the 50 vectors nearest to the first one."""
    d = tx.cosine_distance(F.col("embedding"), F.col("q"))
    return t.embeddings.crossJoin(F.broadcast(_vector0(t))).select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(50).select("vec_id", _r(F.col("d")).alias("d"))


@query("fn13_mean_pool", """
    WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY 1)
    SELECT label, i::INT AS i, round(v / n, 6) AS v FROM m JOIN n USING (label)""")
def mean_pool(t: Tables) -> DataFrame:
    """The normalised mean vector of each label."""
    x = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return m.join(n, "label").select("label", (F.col("i") + 1).alias("i"), _r(F.col("v") / F.col("n")).alias("v"))


@query("fn19_units", """
    WITH u(alias, factor, si) AS (VALUES ('ft', 0.3048, 'm'), ('m', 1.0, 'm'), ('psi', 0.0689476, 'bar'), ('bbl/h', 0.158987, 'm3/h')),
    x AS (SELECT p_partkey, p_size::DOUBLE AS v, CASE p_size % 5 WHEN 0 THEN 'ft' WHEN 1 THEN 'm' WHEN 2 THEN 'psi' WHEN 3 THEN 'bbl/h' END AS k FROM part)
    SELECT p_partkey, round(v * factor, 6)::DOUBLE AS value_si, si AS unit_si FROM x LEFT JOIN u ON alias = k""")
def to_si(t: Tables) -> DataFrame:
    """FN-18, FN-19: units in various spellings to SI; unknown ones give null."""
    unit = F.when(F.col("p_size") % 5 == 0, " FT ").when(F.col("p_size") % 5 == 1, "m").when(F.col("p_size") % 5 == 2, "Psi").when(F.col("p_size") % 5 == 3, "bbl / hour").otherwise("furlong")
    x = t.part.select("p_partkey", F.col("p_size").cast("double").alias("v"), unit.alias("u"))
    return units.to_si(x, "v", "u").select("p_partkey", _r(F.col("value_si")).alias("value_si"), "unit_si")


@query("fn21_quantities", """
    WITH x AS (SELECT p_partkey, p_size AS s FROM part)
    SELECT p_partkey, round(4 * s + 8010.5, 3)::DOUBLE AS total, round(2 * s + 10 + (8000 + s) * 0.3048 + (s + 0.5) * 0.158987, 3)::DOUBLE AS total_si, 'm,m,ft,bbl/hr' AS units FROM x""")
def quantities(t: Tables) -> DataFrame:
    """A range gives both ends, thousands have commas, stands are no unit; the SQL has the numbers that went into the text."""
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("drilled "), s, F.lit("-"), (F.col("p_size") + 10).cast("string"), F.lit(" m after "), s, F.lit(" stands, 8,"), F.lpad(s, 3, "0"), F.lit(" ft above; lost "), s, F.lit(".5 bbl/hr."))
    x = t.part.select("p_partkey", units.quantities(text).alias("q"))
    total = lambda name: _r(F.aggregate("q", F.lit(0.0), lambda a, y: a + y[name]), 3)
    return x.select("p_partkey", total("value").alias("total"), total("value_si").alias("total_si"), F.array_join(F.transform("q", lambda y: y.unit), ",").alias("units"))


@query("fn22_reconciled", """
    SELECT p_partkey, round(CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 1 THEN (1000 + p_size) * 0.3048 ELSE 1000 + p_size END, 4)::DOUBLE AS v,
        CASE p_partkey % 4 WHEN 0 THEN (1000 + p_size)::VARCHAR || ' m' WHEN 1 THEN (1000 + p_size)::VARCHAR || ' ft' END AS raw, CASE WHEN p_partkey % 4 <> 3 THEN 'm' END AS unit FROM part""")
def reconciled(t: Tables) -> DataFrame:
    """A confirmed value, one whose number was copied from feet, one that its snippet says nothing of, and none."""
    k, n = F.col("p_partkey") % 4, 1000 + F.col("p_size")
    snippet = F.when(k == 2, "30 bbl lost").otherwise(F.concat(F.lit("at "), n.cast("string"), F.when(k == 0, " m").otherwise(" ft"), F.lit(" with 12 sg")))
    x = t.part.select("p_partkey", units.reconciled(F.when(k != 3, n.cast("double")), snippet, "m").alias("r"))
    return x.select("p_partkey", _r(F.col("r.value"), 4).alias("v"), "r.raw", "r.unit")


@query("fn20_yield_stress", "SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size / 0.4788026 WHEN 2 THEN p_size * 1000 / 0.4788026 END, 6)::DOUBLE AS y FROM part")
def yield_stress(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    unit = F.when(k == 0, "lbf/100 ft²").when(k == 1, "Pa").when(k == 2, "kPa").otherwise("bar")
    return t.part.select("p_partkey", _r(units.yield_stress(F.col("p_size").cast("double"), unit)).alias("y"))


@query("fn27_highlight", """
    SELECT doc_id, len(regexp_extract_all(lower(text), 'thing|the'))::INT AS n_hits, coalesce(list_sum(list_transform(regexp_extract_all(lower(text), 'thing|the'), lambda x: length(x))), 0)::BIGINT AS n_marked, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL""")
def highlight(t: Tables) -> DataFrame:
    """Texts cut at the query's words; words of one or two letters don't count."""
    x = t.documents.where("text is not null").select("doc_id", tx.highlighted(F.col("text"), "thing of the").alias("p"))
    size = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p.text))
    hits = F.filter("p", lambda p: p.hit)
    return x.select("doc_id", F.size(hits).alias("n_hits"), size(hits).alias("n_marked"), size(F.col("p")).alias("n_chars"))


@query("fn33_well_name", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'W-' || s_suppkey WHEN 1 THEN 'North ' || s_suppkey || '/A' END AS name FROM supplier")
def well_name(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    tag = F.concat(F.lit('<log><nameWell uid="1"> W-'), k, F.lit(" </nameWell></log>"))
    line = F.concat(F.lit("Daily report\n  Well Name : North "), k, F.lit("/A \nDepth: 12 m"))
    return t.supplier.select("s_suppkey", tx.well_name(F.when(k % 3 == 0, tag).when(k % 3 == 1, line).otherwise("the well was dry")).alias("name"))


@query("fn50_bbox", """
    SELECT p_partkey, round(greatest(0, least(1, (p_size - 10) / 30)), 5)::DOUBLE AS x, round(greatest(0, least(1, p_size / 40)) - greatest(0, least(1, (p_size - 10) / 30)), 5)::DOUBLE AS w FROM part""")
def bbox(t: Tables) -> DataFrame:
    """Edges as shares of the page, clamped to it."""
    from wellframe.functions import risk

    left, right = risk.clip01((F.col("p_size") - 10) / 30), risk.clip01(F.col("p_size") / 40)
    return t.part.select("p_partkey", _r(left, 5).alias("x"), _r(right - left, 5).alias("w"))


@query("di07_ordered_unique", "SELECT o_custkey, array_to_string(list_transform(list_sort(list({'k': k, 'p': p})), lambda x: x.p), ',') AS kinds FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY 1")
def ordered_unique(t: Tables) -> DataFrame:
    """Each value once, in the order of its first row: one row of each before any list is made."""
    first = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))), lambda x: x.o_orderpriority)
    return first.groupBy("o_custkey").agg(F.array_join(kinds, ",").alias("kinds"))


@query("pf18_pinned", "SELECT o_orderkey, o_orderstatus <> 'F' AS unacked, o_orderpriority IN ('1-URGENT', '2-HIGH') AS loud, o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS pinned FROM orders")
def pinned(t: Tables) -> DataFrame:
    """Open alerts that nobody has acknowledged, the loud ones, and those that are both."""
    from wellframe.functions import risk

    state = risk.lookup(F.col("o_orderstatus"), {"F": "acknowledged", "O": "viewed"}, "escalated")
    severity = risk.lookup(F.col("o_orderpriority"), {"1-URGENT": "critical", "2-HIGH": "warning"}, "info")
    x = t.orders.select("o_orderkey", risk.unacknowledged(state).alias("unacked"), risk.loud(severity).alias("loud"))
    return x.withColumn("pinned", F.col("unacked") & F.col("loud"))


@query("fn16_ramp", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 12 THEN 0 WHEN l_quantity >= 37 THEN 1 ELSE (l_quantity - 12) / 25 END, 6)::DOUBLE AS v FROM lineitem")
def ramp(t: Tables) -> DataFrame:
    from wellframe.functions import risk

    return t.lineitem.select("l_orderkey", "l_linenumber", _r(risk.ramp(F.col("l_quantity"), 12.0, 37.0)).alias("v"))


@query("fn17_isotonic", """
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 10 THEN 0.05 WHEN l_quantity <= 30 THEN 0.05 + (l_quantity - 10) / 20 * 0.25 WHEN l_quantity <= 40 THEN 0.3 + (l_quantity - 30) / 10 * 0.6 ELSE 0.9 END, 6)::DOUBLE AS p FROM lineitem""")
def isotonic(t: Tables) -> DataFrame:
    """Calibration by the knots of a fitted isotonic curve, flat beyond its ends."""
    from wellframe.functions import risk

    return t.lineitem.select("l_orderkey", "l_linenumber", _r(risk.calibrated(F.col("l_quantity"), [10.0, 30.0, 40.0], [0.05, 0.3, 0.9])).alias("p"))


@query("fn25_squash", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')))) AS h FROM documents WHERE text IS NOT NULL")
def squash(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.md5(tx.squash(F.col("text")).cast("binary")).alias("h"))


@query("fn26_snippet", """
    WITH x AS (SELECT doc_id, text, CASE WHEN contains(lower(text), 'thing') THEN instr(lower(text), 'thing') WHEN contains(lower(text), 'the') THEN instr(lower(text), 'the') ELSE 0 END AS pos FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, md5(substring(text, greatest(1, pos - 100), 300)) AS h FROM x""")
def snippet(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.md5(tx.snippet(F.col("text"), "the thing").cast("binary")).alias("h"))


#: Places of two stems in every text, and the weight of each cover: two different ones next to each other.
_COVERS = """
    w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)),
    h AS (SELECT doc_id, p, w IN ('mit', 'mits') AS k FROM w WHERE w IN ('license', 'licenses', 'licensed', 'licensing', 'mit', 'mits')),
    g AS (SELECT *, lag(k) OVER o AS k0, lag(p) OVER o AS p0 FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    r AS (SELECT doc_id, sum(0.1 / (p - p0)) AS s FROM g WHERE k <> k0 GROUP BY 1)"""


@query("fn28_keyword_rank", f"WITH {_COVERS} SELECT doc_id, round(s, 6) AS s FROM r ORDER BY round(s, 6) DESC, doc_id LIMIT 50")
def keyword_rank(t: Tables) -> DataFrame:
    """The 50 best matches of two words, by stems and cover density."""
    x = textindex.search_texts(t.documents, "doc_id", "text", {"q": "licensed MIT"})
    return x.select(F.col("key").alias("doc_id"), _r(F.col("rank")).alias("s")).orderBy(F.desc("s"), "doc_id").limit(50)


#: Phrases, alternatives and words that must not occur.
WEB_QUERIES = {"phrase": '"mit license"', "or": 'things or "under the mit"', "not": "thing -erring", "both": '"the thing" oning or licenses -apache'}


@query("fn28_websearch")
def websearch(t: Tables) -> DataFrame:
    """Every match of four web-style queries, from one index; tests compare with a scan of all stretches of every text."""
    x = textindex.search(textindex.build(t.documents, "doc_id", "text"), WEB_QUERIES)
    return x.select("query", F.col("key").alias("doc_id"), _r(F.col("rank")).alias("s"))


@query("cq05_hybrid_search", f"""
    WITH {_COVERS},
    k AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, round(s, 6) AS s FROM r) QUALIFY row_number() OVER (ORDER BY s DESC, doc_id) <= 50),
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_cosine_distance(embedding::DOUBLE[], q), 6), vec_id) AS r FROM embeddings, q QUALIFY r <= 50),
    f AS (SELECT coalesce(k.doc_id, v.doc_id) AS doc_id, coalesce(1.0 / (60 + k.r), 0) + coalesce(1.0 / (60 + v.r), 0) AS s FROM k FULL JOIN v ON k.doc_id = v.doc_id),
    c AS (SELECT doc_id, source, lang, doc_id % 50 AS doc, CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 END AS page, n_chars AS a, CASE WHEN doc_id % 7 > 0 THEN n_chars + 500 END AS b FROM documents)
    SELECT f.doc_id, round(s, 8) AS rrf FROM f JOIN c ON c.doc_id = f.doc_id WHERE lang = 'en' AND (b IS NULL OR b >= 700) AND (a IS NULL OR a <= 9000)
      AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.doc AND (c.page IS NULL OR e.event_id % 5 = c.page) AND e.event_type = 'click')
    ORDER BY round(s, 8) DESC, f.doc_id LIMIT 20""")
def hybrid_search(t: Tables) -> DataFrame:
    """Keyword and vector rankings, each cut at 50, fused; filters on language, interval and events come after the cuts."""
    kw = textindex.search_texts(t.documents, "doc_id", "text", {"q": "licensed MIT"}).select("key", _r(F.col("rank")).alias("rank"))
    d = tx.cosine_distance(F.col("embedding"), F.col("q"))
    vec = t.embeddings.crossJoin(F.broadcast(_vector0(t))).select(F.col("vec_id").alias("key"), _r(d).alias("distance"))
    both = textindex.fused(kw, vec).select("key", _r(F.col("score"), 8).alias("score"))
    n = F.col("doc_id")
    chunks = t.documents.select(n.alias("key"), (n % 50).alias("doc"), F.when(n % 3 > 0, n % 5).alias("page"), F.col("lang").alias("formation"), F.col("source").alias("field"), F.col("n_chars").alias("md_from"), F.when(n % 7 > 0, F.col("n_chars") + 500).alias("md_to"))
    events = t.events.select(F.col("user_id").alias("doc"), (F.col("event_id") % 5).alias("page"), "event_type")
    out = textindex.answers(both, chunks, events, formation="en", event_type="click", md_from=700, md_to=9000)
    return out.select(F.col("key").alias("doc_id"), F.col("score").alias("rrf"))


@query("fn29_chunks")
def chunks(t: Tables) -> DataFrame:
    """Chunks of 1200 characters with 200 of overlap; line packing is sequential, so rows only."""
    return tx.chunks(t.documents, "doc_id", "text")


@query("fn32_classify", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[0-9]{3}') THEN 'numbers' ELSE 'other' END AS kind FROM documents WHERE text IS NOT NULL")
def classify(t: Tables) -> DataFrame:
    """The first rule that matches."""
    x = F.col("text")
    return t.documents.where("text is not null").select("doc_id", F.when(x.rlike("(?i)license"), "license").when(x.contains("|"), "table").when(x.rlike("[0-9]{3}"), "numbers").otherwise("other").alias("kind"))


@query("fn30_synonyms", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\b(mit license|license|the)\b', 1)))::INT AS n FROM documents WHERE text IS NOT NULL")
def synonyms(t: Tables) -> DataFrame:
    """Whole-word aliases, the longest first, in one pass."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\b(mit license|license|the)\b"), F.lit(1))
    return t.documents.where("text is not null").select("doc_id", F.size(F.array_distinct(found)).alias("n"))


@query("fn40_safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def safe_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("fn41_sha256", "SELECT page_id, sha256(url || chr(10) || length(html)::VARCHAR) AS cache_key FROM pages")
def cache_key(t: Tables) -> DataFrame:
    """FN-41, SNK-12: content-addressed keys."""
    return t.pages.select("page_id", F.sha2(F.concat_ws("\n", "url", F.length("html").cast("string")), 256).alias("cache_key"))


@query("fn46_nested_json", "SELECT o_custkey, len(list(o_orderkey))::INT AS n, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def nested_json(t: Tables) -> DataFrame:
    """Evidence built as JSON and read back."""
    j = t.orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("events"))).alias("evidence"))
    back = F.from_json("evidence", "struct<events:array<struct<o_orderkey:bigint,o_orderstatus:string>>>")["events"]
    return j.select("o_custkey", F.size(back).alias("n"), F.aggregate(back, F.lit(0).cast("long"), lambda s, x: s + x.o_orderkey).alias("total"))


@query("fn48_latest_map", "SELECT event_id, (value IS NOT NULL)::INT + (nullif(event_type, 'view') IS NOT NULL)::INT AS n FROM events")
def latest_map(t: Tables) -> DataFrame:
    """The channels that have a value, as a map."""
    m = F.map_from_arrays(F.array(F.lit("value"), F.lit("type")), F.array(F.col("value").cast("string"), F.nullif("event_type", F.lit("view"))))
    return t.events.select("event_id", F.size(F.map_filter(m, lambda k, v: v.isNotNull())).alias("n"))


@query("snk11_geojson", "SELECT user_id, len(list(event_id))::INT AS n FROM events GROUP BY 1")
def geojson(t: Tables) -> DataFrame:
    """A line as GeoJSON, read back for its number of points."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda p: F.array(p.value, p.event_id.cast("double")))
    g = t.events.groupBy("user_id").agg(F.to_json(F.struct(F.lit("LineString").alias("type"), pts.alias("coordinates"))).alias("g"))
    return g.select("user_id", F.size(F.from_json("g", "struct<type:string,coordinates:array<array<double>>>")["coordinates"]).alias("n"))


@query("jn25_containment", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_containment(t: Tables) -> DataFrame:
    """Snippets that a page holds: an equi-join on words inside the snippet, then the exact test.

    A snippet's first and last word may begin or end within a word of the page, so the key is three of those between them, or
    one; a snippet without any is found through the parts of the pages' words.  A blank one is tried on every page.
    """
    found = lambda pattern: F.regexp_extract("s", pattern, 1)
    b = t.benchmark.where("text is not null").select("item_id", F.col("text").alias("s"))
    three, one = found(r"^\s*\S+\s+(\S+\s+\S+\s+\S+)\s"), found(r"^\s*\S+\s+(\S+)\s")
    blank = F.regexp_replace("s", r"\s+", "") == ""
    b = b.withColumn("k", F.when(three != "", three).when(one != "", one).when(blank, F.lit("")))
    d = t.documents.where("text is not null").select("doc_id", F.split("text", r"(?<=\s)(?=\S)").alias("w"))
    bare = lambda c: F.regexp_replace(c, r"\s+$", "")
    # Every place where three words begin, and every word: their own text, as it stands.
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: bare(F.array_join(F.slice("w", i, F.lit(3)), "")))
    words = F.array_distinct(F.transform("w", bare))
    keys = F.array_distinct(F.concat(grams, words, F.array(F.lit(""))))
    pairs = d.select("doc_id", F.explode(keys).alias("k")).join(b.where("k is not null"), "k").select("doc_id", "item_id", "s")
    short = b.where("k is null").select("item_id", "s", F.regexp_extract("s", r"(\S+)", 1).alias("part"))
    sizes = [r[0] for r in short.select(F.length("part")).distinct().collect()]
    if sizes:
        each = d.select("doc_id", F.explode(words).alias("word"))
        at = each.select("word").distinct().withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where(F.length("word") >= F.col("n"))
        parts = at.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("i")).select("word", F.expr("substring(word, i, n)").alias("part")).distinct()
        hits = parts.join(short, "part").select("word", "item_id", "s")
        pairs = pairs.unionByName(each.join(hits, "word").select("doc_id", "item_id", "s"))
    return pairs.distinct().join(t.documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("s"))).select("doc_id", "item_id").distinct()


@query("jn25_fuzzy_snippets")
def fuzzy_snippets(t: Tables) -> DataFrame:
    """Snippets of 80 characters, read badly, looked for on their own page and on the next one: partial ratios of 80 and more."""
    d = t.documents.where("text is not null").select("doc_id", "text")
    s = d.select("doc_id", F.translate(F.substring("text", (F.col("doc_id") % 200 + 1).cast("int"), F.lit(80)), "el", "c1").alias("snippet"))
    asked = s.select("doc_id", "snippet", F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("page"))
    both = dealt(asked, ["page"]).join(dealt(d.select(F.col("doc_id").alias("page"), "text"), ["page"]), "page")
    return both.select("doc_id", "page", _r(fuzzy.snippet_ratio(F.col("snippet"), F.col("text"), 80.0), 4).alias("ratio")).where("ratio > 0")


_ALIASES = {"MIT License": "mit", "the thing": "thing", "things": "thing", "Und": "und", "license": "license", "onha": "onha"}


def _pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as pages, three to a document; of every page one snippet and one top are known."""
    n = F.col("doc_id")
    d = t.documents.where("text is not null").select(n.alias("n"), F.floor(n / 3).alias("doc_id"), (n % 3).alias("page"), "text")
    snippet = F.translate(F.substring("text", 31, 60), "q", "g")
    events = d.select("doc_id", "page", F.lit(0).alias("ord"), snippet.alias("snippet"), F.concat(F.lit("F"), (F.col("n") % 4).cast("string")).alias("formation"), (F.col("n") * 1.0).alias("md_from_m"), (F.col("n") + 10.0).alias("md_to_m"))
    tops = d.select("doc_id", "page", F.lit(1).alias("ord"), F.lit(None).cast("string").alias("snippet"), F.lit("thing").alias("formation"), (F.col("n") - 5.0).alias("md_from_m"), F.lit(None).cast("double").alias("md_to_m"))
    return d.drop("n"), events.unionByName(tops)


@query("cq16_chunk_index")
def chunk_index(t: Tables) -> DataFrame:
    """FN-31, CQ-16: every page's chunks with formation and depths; the tests compare with plain code, and refreshing with building."""
    pages, entities = _pages(t)
    return indexing.build(pages, entities, indexing.Aliases.of(_ALIASES))


@query("src16_changes", """
    WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 1)
    SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(n.o_orderstatus, o.o_orderstatus) AS status
    FROM o FULL JOIN n USING (o_orderkey) WHERE (o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice) AND coalesce(n.o_totalprice, o.o_totalprice) >= 1000""")
def snapshot_changes(t: Tables) -> DataFrame:
    """SRC-16: inserted, updated and deleted orders between two states of the table, as a subscriber with a filter sees them."""
    k, row = F.col("o_orderkey"), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = row.where(k % 10 != 1).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    feed = changes.subscribed(changes.changes(row.where(k % 10 != 0), new, ["o_orderkey"]), "o_totalprice=gte.1000")
    return feed.select("o_orderkey", "op", F.coalesce("new.o_orderstatus", "old.o_orderstatus").alias("status"))


@query("st22_latest_view", "SELECT user_id, event_id % 8 AS slot, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error'")
def latest_view(t: Tables) -> DataFrame:
    """ST-22: the view of each key's last change; errors are deletions."""
    feed = t.events.select("user_id", (F.col("event_id") % 8).alias("slot"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.struct("value").alias("new"))
    return changes.latest(feed, ["user_id", "slot"]).select("user_id", "slot", "seq", "new.value")
