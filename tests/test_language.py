"""The search language: unit and metamorphic tests, no Spark."""

import pytest
from hypothesis import given, strategies as st

from quern.plans import entities, hangul
from quern.plans.language import Filters, Term, completion_context, completions, date_bounds, date_range, expand, prepare, resolve_source, validate_news_query

SOURCES = [{"id": "s1", "name": "First Source", "host": "a.example.org"}, {"id": "s2", "name": "Second", "host": "b.example.kp"}]


def plan(text):
    return prepare(text, SOURCES)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("foo NOT bar", "foo -bar"), ("foo NOT site:s1", "-site:s1 foo"), ("site:(a.example.org) foo", "site:a.example.org foo"), ("제목:foo", "intitle:foo"),
        ("date:2024-01..2024-02 foo", "after:2024-01 before:2024-02 foo"), ("foo AND bar", "foo bar"), ("+foo bar", "foo bar"), ("foo | bar", "foo OR bar"), ("(foo OR bar) baz", "foo baz OR bar baz"),
    ],
)
def test_equal_plans(a, b):
    x, y = plan(a), plan(b)
    assert (x.branches, x.excluded, x.filters) == (y.branches, y.excluded, y.filters)


def test_phrases_scopes_and_exclusions():
    p = plan('"two words" intitle:head -"not this" -inurl:path word')
    b = p.branches[0]
    assert [t.value for t in b.phrases] == ["two words"] and [t.value for t in b.title] == ["head"]
    assert [t.value for t in p.excluded.generic] == ["not this"] and [t.value for t in p.excluded.url] == ["path"]


def test_usable_terms():
    assert not Term("ab").usable and Term("abc").usable and Term("가나").usable and not Term("!!??").usable


def test_dates():
    assert date_bounds("2024") == ("2024-01-01", "2024-12-31") and date_bounds("2024-02") == ("2024-02-01", "2024-02-29")
    assert date_bounds("2023-02-29") is None and date_bounds("1899") is None and date_bounds("2024년 3월 5일") == ("2024-03-05", "2024-03-05")
    assert date_range("2024-03..2024-01") is None and date_range("..2024-01") == ("", "2024-01-31")


def test_unresolved_operators_stay():
    p = plan("site:nowhere.example foo")
    assert "site:nowhere.example" in p.text and p.filters == Filters()


def test_source_resolution():
    assert resolve_source("kp", SOURCES) == ["s2"] and resolve_source("first source", SOURCES) == ["s1"] and resolve_source("x", SOURCES) == []
    assert plan("First Source").exact_source == "s1"


def test_expand_is_disjunctive():
    assert expand("(a OR b) (c OR d)") == ["a c", "a d", "b c", "b d"]
    assert expand('"x OR y" z') == ['"x OR y" z']


def test_entities():
    assert entities.resolve("asl") == "apache-license" and entities.resolve("nothing") is None
    assert entities.segment("unasl") == ["united-nations", "apache-license"] and entities.segment("unzzz") is None


def test_completion():
    assert completion_context("foo -lang:e")["kind"] == "lang"
    assert completions("x site:b", SOURCES) == ["x site:b.example.kp"]
    assert completions("x source:fir", SOURCES) == ['x source:"First Source"']


def test_news_query():
    assert validate_news_query(" A b ") == ["a", "b"]
    with pytest.raises(ValueError):
        validate_news_query("x" * 101)


@given(st.text(max_size=60))
def test_any_text_gives_a_plan(text):
    p = plan(text)
    assert all(t.usable for b in p.branches for t in b.terms)


def test_typed_hangul():
    assert hangul.typed("gksrmf") == "한글" and hangul.typed("dkssudgktpdy") == "안녕하세요" and hangul.typed("ekfr") == "닭" and hangul.typed("ekfrdl") == "닭이" and hangul.typed("dhk") == "와"
    assert hangul.conversion("gksrmf") == "한글" and hangul.conversion("search") == "" and hangul.conversion("한글 abc") == ""
    assert [t.value for t in plan("gksrmf").branches[0].terms] == ["gksrmf", "한글"]
