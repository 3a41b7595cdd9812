"""Embedded elements hide at most themselves."""

import pytest

from codeloom.llm.html_blocks import blocks

REST = ["One is here.", "Two is here."]


def texts(middle):
    return [b[0] for b in blocks(f"<article><p>One is here.</p>{middle}<p>Two is here.</p></article>")]


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "template", "select", "noscript"])
def test_unclosed_and_self_closed_elements_hide_nothing_after_them(tag):
    assert texts(f"<{tag} class='x'>") == REST
    assert texts(f"<{tag} class='x'/>") == REST
    assert texts(f"<{tag}><{tag}>") == REST
    assert texts(f"<div><{tag}></div>") == REST


@pytest.mark.parametrize("tag", ["svg", "canvas", "template", "select", "noscript"])
def test_nested_hidden_elements_end_at_their_own_end(tag):
    assert texts(f"<{tag}>a<{tag}>b</{tag}>c<p>d</p></{tag}>") == REST


def test_text_of_math_and_object_is_kept():
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>") == [REST[0], "So x=2 holds.", REST[1]]
    assert texts("<object data='f'><p>A table of rain.</p></object>") == [REST[0], "A table of rain.", REST[1]]
    assert texts("<p>An <svg><title/><style/><path d='m'/><text>no</text></svg>icon.</p>") == [REST[0], "An icon.", REST[1]]
    assert texts("<script>'<p>'") == REST[:1]
