"""Text rules: slugs, attribute maps, variant keys, redaction, idempotency keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Retailer labels of attributes.
LABELS = {"colour": "color", "color": "color", "storage": "storage", "size": "size"}


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one hyphen, none at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def label_key(key: Column) -> Column:
    snake = F.regexp_replace(slug(key), "-", "_")
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.lower(F.trim(key))], snake)


def normal_attributes(attributes: Column) -> Column:
    """Lower-cased, trimmed map with canonical keys; null if it is empty or has a blank key or value."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.struct(label_key(e["key"]).alias("key"), F.lower(F.trim(e["value"])).alias("value")))
    bad = F.exists(pairs, lambda p: F.coalesce(p["key"], F.lit("")).isin("") | F.coalesce(p["value"], F.lit("")).isin(""))
    return F.when(attributes.isNotNull() & (F.size(attributes) > 0) & ~bad, F.map_from_entries(pairs))


def variant_key(attributes: Column) -> Column:
    """k=v pairs in the order of their keys, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


HIDDEN = "[REDACTED]"
#: What credentials look like in free text; {1} is the first group, which engines name differently.
SECRETS = [("(?i)(rediss?://)([^/@]+)@", "{1}" + HIDDEN + "@"), ("(?i)(bearer\\s+)[^\\s]+", "{1}" + HIDDEN), ("(?i)\\b(api[-_]?key|token|password|secret|authorization|access[-_]?key)\\s*[:=]\\s*\\S+", "{1}=" + HIDDEN), ("^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "{1}" + HIDDEN + "@")]


def redacted(text: Column, length: int = 1000) -> Column:
    """Trimmed text without credentials, cut to a length with dots; null for blank text."""
    out = F.nullif(F.trim(text), F.lit(""))
    for pattern, to in SECRETS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to.replace("{1}", "$1")))
    return F.when(F.length(out) > length, F.concat(F.substring(out, 1, length - 3), F.lit("..."))).otherwise(out)


def idempotency_key(job: Column, retailer: Column, scope: Column, length: int = 512) -> Column:
    """job|retailer|scope as canonical JSON without empty values, hashed where it is too long."""
    entries = F.array_sort(F.filter(F.map_entries(scope), lambda e: e["value"].isNotNull() & (e["value"] != "")))
    text = F.when(scope.isNull() | (F.size(entries) == 0), "*").otherwise(F.to_json(F.map_from_entries(entries)))
    head = F.concat(job, F.lit("|"), retailer, F.lit("|"))
    raw = F.concat(head, text)
    return F.when(F.length(raw) <= length, raw).otherwise(F.substring(F.concat(head, F.sha2(raw, 256)), 1, length))


def event_error(row_type: Column, source: Column, source_ref: Column, retailer: Column, category: Column, brand: Column, start: Column, end: Column) -> Column:
    """The first rule that a sale event breaks, null if it is valid."""
    external = source.isin("official_api", "affiliate_feed", "product_feed", "other_permitted")
    return (
        F.when(start.isNull() | end.isNull() | (end < start), "bad_dates")
        .when((row_type == "retailer_specific") & retailer.isNull(), "retailer_required").when((row_type == "brand") & brand.isNull(), "brand_required").when((row_type == "category") & category.isNull(), "category_required")
        .when((row_type == "manually_curated") & (source != "manual_curation"), "source_not_manual").when((source == "observed_price_inference") & (row_type == "externally_sourced"), "inference_not_external")
        .when((row_type == "externally_sourced") & ~external, "source_not_permitted").when((row_type == "externally_sourced") & (F.trim(F.coalesce(source_ref, F.lit(""))) == ""), "source_ref_required")
    )
