"""The whole analysis of all sites as one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..operators import colors, consistency, contact, identity, marketing, merge, pages as P, seo, typography
from ..session import cut
from ..streaming.progress import SECTIONS


class Sections(Mapping):
    """A report's sections by name, each a table that is planned when it is first asked for; what several share is written once."""

    def __init__(self, raw: DataFrame, fetched: DataFrame | None = None, records: DataFrame | None = None, areas: DataFrame | None = None):
        self._raw, self._fetched, self._records, self._areas = raw, fetched, records, areas
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def _parsed(self) -> DataFrame:
        return cut(P.parse_pages(self._raw))

    @cached_property
    def _sheets(self) -> DataFrame:
        return P.bounded_stylesheets(P.page_stylesheets(self._parsed, self._fetched))

    @cached_property
    def _palette(self) -> DataFrame:
        return cut(colors.extract_colors(self._parsed, self._sheets, self._areas))

    def _colors(self) -> DataFrame:
        if self._records is None:
            return self._palette
        own = self._palette.select("site", F.col("rank").alias("ord"), "hex", "role", "confidence", F.lit("extracted").alias("source"), "area_share")
        return merge.merge_colors(own, merge.record_colors(self._records)).withColumnRenamed("ord", "rank")

    @cached_property
    def _fonts(self) -> DataFrame:
        return cut(typography.extract_typography(typography.from_css(self._parsed, self._sheets)))

    @cached_property
    def _tones(self) -> DataFrame:
        return cut(identity.tones(identity.copy_for_analysis(self._parsed)))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = {
                "pages": lambda: self._parsed,
                "colors": self._colors,
                "typography": lambda: self._fonts,
                "logo": lambda: identity.logos(self._parsed),
                "seo": lambda: seo.seo_report(self._parsed),
                "geo": lambda: contact.geo_report(self._parsed),
                "social": lambda: contact.social_links(contact.page_social_links(self._parsed)),
                "marketing": lambda: marketing.marketing_elements(self._parsed),
                "brand_name": lambda: identity.brand_names(self._parsed),
                "tone": lambda: self._tones,
                "summary": lambda: identity.summaries(self._parsed, self["brand_name"]),
                "consistency": lambda: consistency.consistency_report(self._parsed, self._sheets, self["colors"], self._fonts, self._tones, self._areas),
            }[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SECTIONS)

    def __len__(self) -> int:
        return len(SECTIONS)


def analyse(raw: DataFrame, fetched: DataFrame | None = None, records: DataFrame | None = None, areas: DataFrame | None = None) -> Sections:
    """raw(url, html, optional page_ord), fetched stylesheets(url, css), third-party records -> a table per report section, planned when it is read."""
    return Sections(raw, fetched, records, areas)


def run_sections(sections: Sections, write: Callable[[str, DataFrame], None]) -> dict[str, str | None]:
    """Write each section by itself; what stopped a section, or null. A section that fails, or one that needs it, leaves the others be."""
    out: dict[str, str | None] = {}
    for name in sections:
        try:
            write(name, sections[name])
            out[name] = None
        except (PySparkException, Py4JJavaError) as failure:
            out[name] = str(failure).split("\n", 1)[0][:500]
    return out


def section_status(sections: Sections, folder: str) -> DataFrame:
    """site, section, status (done, empty: nothing found, failed), n_rows, error, for every site of the pages and every section; the sections are written below `folder`."""
    spark = sections._raw.sparkSession
    failed = run_sections(sections, lambda name, rows: rows.write.mode("overwrite").parquet(f"{folder}/{name}"))
    sites = sections["pages"].select("site").distinct()
    rows = None
    for name, error in failed.items():
        counted = sites.withColumn("n_rows", F.lit(None).cast("long")) if error else sites.join(spark.read.parquet(f"{folder}/{name}").groupBy("site").agg(F.count("*").alias("n_rows")), "site", "left").na.fill(0, ["n_rows"])
        status = F.lit("failed") if error else F.when(F.col("n_rows") > 0, "done").otherwise("empty")
        part = counted.select("site", F.lit(name).alias("section"), status.alias("status"), "n_rows", F.lit(error).cast("string").alias("error"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def report_rows(parts: Mapping[str, DataFrame], generated_at) -> DataFrame:
    """One row per site for the exports: names, score, palette, fonts, traits, links."""
    listed = lambda df, *cols: df.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("v"))
    c = listed(parts["colors"], "role", "hex").withColumnRenamed("v", "colors")
    f = listed(parts["typography"], "role", "name", "variants").withColumnRenamed("v", "fonts")
    s = listed(parts["social"], "platform", "url").withColumnRenamed("v", "links")
    rows = parts["brand_name"].join(parts["summary"].select("site", "description"), "site").join(parts["consistency"].select("site", "n_pages", "score", "grade"), "site").join(parts["tone"].select("site", "traits"), "site")
    for part in (c, f, s):
        rows = rows.join(part, "site", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return rows.select("site", "brand_name", generated_at.alias("generated_at"), "score", "grade", "n_pages", "description", "traits", none("colors", c.schema["colors"].dataType), none("fonts", f.schema["fonts"].dataType), none("links", s.schema["links"].dataType))
