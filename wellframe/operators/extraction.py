"""Extracted items of documents, validated in one scan: rows by kind, and those refused with their reasons.

Each document has one JSON payload with a list of items for each kind (and one header).  It is parsed once, as a variant; its items
are one flat table, in which an item of a wrong shape, a payload that is no JSON, and a list that is none are rows with reasons,
not errors.  What is accepted carries its normalised values, failed rules and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.functions import activity, fuzzy, risk, shapes, units
from wellframe.operators.stages import dealt

# The fields of each kind of item.
ITEM = {"page": "int?", "snippet": "string?", "confidence": "number"}
KINDS: dict[str, shapes.Shape] = {
    "well_header": {"td_md_m": "number?", "kb_elev_m": "number?", "field": "string?", "basin": "string?"},
    "events": {"event_type": list(risk.RISK_OF_EVENT), "md_from_m": "number?", "md_to_m": "number?", "formation": "string?", "npt_h": "number?", "volume_m3": "number?", "event_date": "iso?", **ITEM},
    "formation_tops": {"formation": "string", "top_md_m": "number?", "top_tvdss_m": "number?", **ITEM},
    "hole_sections": {"hole_size_in": "number?", "casing_od_in": "number?", "md_from_m": "number?", "md_to_m": "number?", "shoe_md_m": "number?", "toc_md_m": "number?", **ITEM},
    "cement_jobs": {"job_type": "string?", "slurry_density_sg": "number?", "volume_m3": "number?", "woc_h": "number?", **ITEM},
    "mud_records": {"md_m": "number?", "mw_sg": "number?", "pv_cp": "number?", "yp_lbf100ft2": "number?", **ITEM},
    "time_log": {"start": "string?", "end": "string?", "description": "string", "iadc_code": "int?", **ITEM},
}
#: Fields that a snippet may quote in another unit, and that unit in SI.
QUOTED = {"md_from_m": "m", "md_to_m": "m", "top_md_m": "m", "top_tvdss_m": "m", "shoe_md_m": "m", "toc_md_m": "m", "md_m": "m", "npt_h": "h", "woc_h": "h", "volume_m3": "m3", "slurry_density_sg": "sg", "mw_sg": "sg"}
#: A snippet is on its page from this partial ratio on.
ON_PAGE = 80.0


def items(documents: DataFrame, doc: str, payload: str) -> DataFrame:
    """doc, kind, item_no, item (variant), reasons: every item of every kind, and what can't be read at all."""
    parsed = dealt(documents.select(F.col(doc).alias("doc"), F.col(payload).alias("payload")), ["doc"]).select("doc", F.try_parse_json("payload").alias("v"))

    def one(kind: str, n: Column, item: Column, why: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("item_no"), item.alias("item"), why.cast("array<string>").alias("why"))

    def each(kind: str) -> Column:
        return F.transform(F.try_variant_get("v", f"$.{kind}", "array<variant>"), lambda x, i: one(kind, i, x, F.array()))

    lists = []
    for kind in KINDS:
        held = F.try_variant_get("v", f"$.{kind}", "variant")
        type_ = F.schema_of_variant(held)
        absent = held.isNull() | (type_ == "VOID")
        if kind == "well_header":
            lists.append(F.when(~absent, F.array(one(kind, F.lit(0), held, F.array()))))
        else:
            lists.append(F.when(absent, F.lit(None)).when(F.startswith(type_, F.lit("ARRAY")), each(kind)).otherwise(F.array(one(kind, F.lit(None), held, F.array(F.lit("not a list"))))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("item_no"), F.lit(None).cast("variant").alias("item"), F.array(F.lit("payload is not an object")).alias("why")))
    fine = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    all_ = F.when(F.coalesce(fine, F.lit(False)), F.flatten(F.array_compact(F.array(*lists)))).otherwise(none)
    flat = parsed.select("doc", F.explode(all_).alias("x")).select("doc", "x.*")
    checked = F.when(F.size("why") > 0, F.col("why"))
    for kind, shape in KINDS.items():
        checked = checked.when(F.col("kind") == kind, shapes.problems(F.col("item"), shape))
    return flat.select(F.col("doc").alias(doc), "kind", "item_no", "item", checked.alias("reasons"))


def validated(documents: DataFrame, doc: str, payload: str, pages: DataFrame, depths: DataFrame, formations: DataFrame) -> DataFrame:
    """doc, kind, item_no, accepted, reasons, values (map of numbers in SI), raw (map of quotations), formation, iadc_code,
    failed (rules), confidence, status of every item; pages: doc, page, text, ocr_confidence; depths: doc, td_md_m; formations:
    alias, formation (exact in lower case).
    """
    x = items(documents, doc, payload).withColumn("accepted", F.size("reasons") == 0)
    get = lambda f, k: F.try_variant_get("item", f"$.{f}", k)
    x = x.withColumns({"page": get("page", "int"), "snippet": get("snippet", "string"), "stated": get("confidence", "double"), "named": F.lower(F.trim(get("formation", "string")))})
    known = formations.select(F.lower(F.trim("alias")).alias("named"), F.col("formation"))
    # The pages come last, and what follows stays in the tasks of that join: values and snippets take far longer than their bytes say.
    texts = dealt(pages.select(F.col(doc), "page", F.col("text").alias("page_text"), "ocr_confidence"), [doc, "page"])
    x = x.join(known, "named", "left").join(depths.select(F.col(doc), "td_md_m"), doc, "left")
    x = dealt(x, [doc, "page"]).join(texts, [doc, "page"], "left")
    x = x.withColumn("_quotes", F.when(F.col("accepted"), units.quantities(F.coalesce("snippet", F.lit("")))))
    stated_values = [F.struct(F.lit(f).alias("f"), get(f, "double").alias("v"), F.lit(u).alias("u"), F.lit(units.ABS_TOLERANCE.get(u, 0.01)).alias("least")) for f, u in QUOTED.items()]
    x = x.withColumn("_stated", F.when(F.col("accepted"), F.filter(F.array(*stated_values), lambda e: e.v.isNotNull())).otherwise(F.array().cast(_STATED)))
    x = x.withColumn("_q", F.transform("_stated", lambda e: F.struct(e.f.alias("f"), units.reconcile(e.v, F.col("_quotes"), e.u, e.least).alias("q"))))
    values = F.map_from_entries(F.transform("_q", lambda e: F.struct(e.f, e.q.value)))
    raw = F.map_from_entries(F.transform(F.filter("_q", lambda e: e.q.raw.isNotNull()), lambda e: F.struct(e.f, e.q.raw)))
    date = F.to_date(F.substring(get("event_date", "string"), 1, 10))
    x = x.withColumns({"values": values, "raw": raw, "date": F.when(F.col("accepted"), date)})
    md, to = F.col("values")["md_from_m"], F.col("values")["md_to_m"]
    deep = F.exists(F.map_values(F.map_filter("values", lambda k, v: F.endswith(k, F.lit("_m")))), lambda v: (v < 0) | (v > F.col("td_md_m")))
    on_page = fuzzy.snippet_ratio(F.col("snippet"), F.col("page_text"), ON_PAGE) >= ON_PAGE
    rules = {
        "depth out of range": deep,
        "interval upside down": md > to,
        "date out of range": (F.col("date") < "1950-01-01") | (F.col("date") > F.current_date()),
        "unknown formation": F.col("named").isNotNull() & (F.col("named") != "") & F.col("formation").isNull(),
        "snippet not on page": (F.col("kind") != "well_header") & ~F.coalesce(on_page, F.lit(False)),
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]))
    x = x.withColumn("failed", F.when(F.col("accepted"), failed).otherwise(F.array().cast("array<string>")))
    stated = F.coalesce("stated", F.lit(0.8))
    confidence = F.least(F.coalesce("ocr_confidence", F.lit(1.0)), F.greatest(F.lit(0.0), stated - 0.3 * F.size("failed")))
    code = F.when(F.col("kind") == "time_log", F.coalesce(get("iadc_code", "int"), activity.code(get("description", "string"))))
    status = F.when(~F.col("accepted"), "rejected").when((F.size("failed") == 0) & (confidence >= 0.8), "auto_approved").otherwise("pending")
    return x.select(doc, "kind", "item_no", "accepted", "reasons", "values", "raw", "formation", code.alias("iadc_code"), "failed", F.round(confidence, 6).alias("confidence"), status.alias("status"))


_STATED = "array<struct<f:string,v:double,u:string,least:double>>"
