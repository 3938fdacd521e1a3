"""XMP sidecars: rendering as one column expression, and a sink that never opens the photo."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from shoebox.functions.scalar import hierarchy_levels, sidecar_path, star_attr, xml_escape, xmp_flag

# Fixed values.
NAMESPACES = {
    "xmp": "http://ns.adobe.com/xap/1.0/", "xap": "http://ns.adobe.com/xap/1.0/", "dc": "http://purl.org/dc/elements/1.1/",
    "crs": "http://ns.adobe.com/camera-raw-settings/1.0/", "lr": "http://ns.adobe.com/lightroom/1.0/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}
CREATOR = "Shoebox 1.0"


def declarations(*prefixes: str) -> str:
    """Namespace attributes; an unknown prefix is a KeyError."""
    return "".join(f' xmlns:{p}="{NAMESPACES[p]}"' for p in prefixes)


def element(tag: str | Column, text: Column) -> Column:
    """An element with escaped text, self-closing if null or empty."""
    t = F.lit(tag) if isinstance(tag, str) else tag
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, F.concat(F.lit("<"), t, F.lit("/>"))).otherwise(F.concat(F.lit("<"), t, F.lit(">"), xml_escape(text), F.lit("</"), t, F.lit(">")))


def _if(condition: Column, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.lit(""))


def keywords(hierarchy="event_hierarchy", words="keywords") -> Column:
    """Levels of the hierarchy, then the keywords; repeats stay."""
    return F.concat(hierarchy_levels(hierarchy), F.coalesce(F.col(words), F.array().cast("array<string>")))


def render(title="event_title", hierarchy="event_hierarchy", stars="star_rating", words="keywords", flag: Column | None = None) -> Column:
    """The document of a row with an edit's columns and the item's group columns."""
    title, hierarchy, stars = F.col(title), F.col(hierarchy), F.col(stars)
    flag = xmp_flag() if flag is None else flag
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    kws = F.coalesce(F.col(words), F.array().cast("array<string>"))
    levels = hierarchy_levels(hierarchy)
    rdf = declarations("rdf")
    star = star_attr(stars)
    rated = (stars > 0) & star.isNotNull()
    nested = F.concat(F.lit("<lr:Hierarchy><lr:Event>"), element("dc:title", F.when(there(title), title).otherwise(hierarchy)), F.lit("</lr:Event></lr:Hierarchy>"))
    about = F.concat(_if(there(flag), element("lr:Flag", flag)), _if(there(title), element("lr:Headline", title)), _if(there(hierarchy), nested), _if(rated, element("lr:Star", star)))
    first = F.concat(
        F.lit(f'  <rdf:Description{rdf}{declarations("lr", "xap", "dc")} xap:CreatorTool="{CREATOR}"'),
        F.when(star == "0", "").otherwise(F.concat(F.lit(' xmp:Rating="'), star, F.lit('"'))), F.lit(">"), about, F.lit("</rdf:Description>"),
    )
    numbered = F.array_join(F.transform(levels, lambda x, i: element(F.concat(F.lit("crs:Level"), (i + 1).cast("string")), x)), "")
    subject = F.concat(numbered, F.array_join(F.transform(kws, lambda x: element("crs:HierarchicalSubject", x)), ""), _if(flag == "No", element("crs:DuplicateOf", F.lit("true"))))
    second = F.when(there(hierarchy) | (F.size(kws) > 0) | F.coalesce(flag == "No", F.lit(False)), F.concat(F.lit(f"  <rdf:Description{rdf}{declarations('crs')}>"), subject, F.lit("</rdf:Description>")))
    bag = F.array_join(F.transform(F.concat(levels, kws), lambda x: element("rdf:li", x)), "")
    body = F.concat(_if(there(title), element("dc:title", title)), _if(F.size(F.concat(levels, kws)) > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), bag, F.lit("</rdf:Bag></dc:subject>"))))
    third = F.concat(F.lit(f"  <rdf:Description{rdf}{declarations('dc')}>"), body, F.lit("</rdf:Description>"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', f"<xmp:xmpmeta{declarations('xmp')}>", f"  <rdf:RDF{rdf}>"]
    return F.concat_ws("\n", *map(F.lit, head), first, second, third, F.lit("  </rdf:RDF>"), F.lit("</xmp:xmpmeta>"))


def with_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """``items`` with the columns of their edit (by item_id), or of the one edit that all share."""
    if "item_id" in edits.columns:
        return items.join(edits, "item_id", "left")
    return items.crossJoin(F.broadcast(edits.limit(1)))


def sidecars(items: DataFrame, edits: DataFrame, out_dir: str | None = None) -> DataFrame:
    """(item_id, sidecar_path, document)."""
    return with_edits(items, edits).select("item_id", sidecar_path("file_path", out_dir).alias("sidecar_path"), render().alias("document"))


def write_sidecars(documents: DataFrame, sidecar_name: str | None = None) -> DataFrame:
    """Write (sidecar_path, document) rows as UTF-8 files, to a path or URI that all executors reach; the paths written.

    A task that runs again writes the same bytes, through a temporary name. ``sidecar_name`` puts one item's
    document under a literal name; with more items it is an error, as they would overwrite each other.
    """
    if sidecar_name is not None:
        if len(documents.limit(2).collect()) > 1:
            raise ValueError("one literal name for several sidecars")
        name = F.concat(F.regexp_extract("sidecar_path", r"\A(.*/)?", 0), F.lit(sidecar_name))
        documents = documents.withColumn("sidecar_path", name)

    def run(batches):
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch.column("sidecar_path").to_pylist(), batch.column("document").to_pylist()):
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                if at.rpartition("/")[0] not in made:
                    system.create_dir(at.rpartition("/")[0] or ".", recursive=True)
                    made.add(at.rpartition("/")[0])
                part = f"{at}.{os.getpid()}.part"
                with system.open_output_stream(part) as f:
                    f.write(text.encode())
                system.move(part, at)
            yield pa.RecordBatch.from_arrays([batch.column("sidecar_path")], ["sidecar_path"])

    return documents.select("sidecar_path", "document").mapInArrow(run, "sidecar_path string")
