"""Sections of a report: planned when read, written by themselves, and none brought down by another or by a page."""

import pytest

from brandloom.functions.html import parse_page, tree_of
from brandloom.operators import pages as P
from brandloom.plans.analysis import Sections, analyse, run_sections, section_status
from brandloom.streaming.progress import SECTIONS

PAGES = [
    ("https://mill.example/", 1, "<title>Mill | Mill</title><meta name=description content=x><h1>Stone ground flour daily</h1><style>body{font-family:Sora;color:#e11d48}</style><a href='https://instagram.com/millexample'>i</a><p>Subscribe to our newsletter</p>"),
    ("https://mill.example/a", 2, "<title>A | Mill</title><h1>Stone oven</h1>"), ("https://quay.example/", 1, "<![bad markup><title>Quay</title>"), ("https://quay.example/x", 2, None),
]


def _raw(spark):
    return spark.createDataFrame(PAGES, "url string, page_ord int, html string")


def _status(rows):
    return {(r.site, r.section): r.status for r in rows.collect()}


def test_all_sections(spark, tmp_path):
    got = _status(section_status(analyse(_raw(spark)), str(tmp_path)))
    assert {s for _, s in got} == set(SECTIONS) and set(got.values()) <= {"done", "empty"}
    assert got["mill.example", "colors"] == got["mill.example", "typography"] == got["mill.example", "social"] == got["mill.example", "marketing"] == "done"
    assert got["quay.example", "colors"] == "empty" and got["quay.example", "pages"] == got["quay.example", "seo"] == "done"


@pytest.mark.parametrize(("wrong", "falls"), [
    ({"records": "name string"}, {"colors", "consistency"}), ({"fetched": "href string"}, {"colors", "typography", "consistency"}), ({"areas": "site string"}, {"colors", "consistency"}),
])
def test_a_section_that_fails_leaves_the_others(spark, tmp_path, wrong, falls):
    """A table that lacks its columns stops the sections that read it, and no others."""
    sections = Sections(_raw(spark), **{k: spark.createDataFrame([], v) for k, v in wrong.items()})
    rows = section_status(sections, str(tmp_path))
    assert {r.section for r in rows.filter("status = 'failed'").collect()} == falls
    assert all(r.error for r in rows.filter("status = 'failed'").collect()) and rows.filter("status <> 'failed' and error is not null").count() == 0
    assert {r.site for r in rows.filter("section = 'seo' and status = 'done'").collect()} == {"mill.example", "quay.example"}


def test_any_section_may_fail(spark):
    """Each of the twelve by turns, as its write: all others are written."""
    sections = analyse(_raw(spark))
    for bad in SECTIONS:
        written = []

        def write(name, rows, bad=bad, written=written):
            if name == bad:
                rows.selectExpr("raise_error('full')").collect()
                rows.sparkSession.sql("select raise_error('full')").collect()
            written.append(name)

        outcome = run_sections(sections, write)
        assert [n for n in SECTIONS if outcome[n]] == [bad] and written == [n for n in SECTIONS if n != bad]


def test_sections_are_planned_when_read(spark):
    sections = analyse(_raw(spark))
    assert "_fonts" not in sections.__dict__ and len(sections) == 12
    sections["seo"]
    assert "_parsed" in sections.__dict__ and not {"_fonts", "_palette", "_tones"} & set(sections.__dict__)


def test_markup_that_stops_the_parser(monkeypatch):
    for html in ("<title>a</title><![img x]><h1>b</h1>", "<![", "<![ x", '<script type="application/ld+json">' + "[" * 100_000 + "</script><h1>b</h1>"):
        assert parse_page(html, "https://a.org/")["headings"] in ([], [{"level": 1, "text": "b"}]) and isinstance(tree_of(html), list)
    real = P.parse_page

    def broken(html, url):
        if html:
            raise RuntimeError("no good")
        return real(html, url)

    monkeypatch.setattr(P, "parse_page", broken)
    page = P._page("<title>a</title>", "https://a.org/")
    assert page["parse_error"] == "RuntimeError: no good" and page["title"] == ""
