"""Elements that hold no raw text lose nothing of the page."""

import pytest

from rangeweave.llm import html_text

STORY = "<article><h1>A title here</h1><p>The first sentence of the story.</p><p>And the second one follows.</p></article>"
LINES = ["A title here", "The first sentence of the story.", "And the second one follows."]
texts = lambda page: [b.text for b in html_text.blocks(page)]


@pytest.mark.parametrize(
    "before",
    [
        "<header><form><input list=x><datalist id=x><option>one<option value=two></datalist></form></header>",
        "<header><form><select><optgroup label=a><option>one<option>two<optgroup label=b><option>three</select></form></header>",
        '<header><svg class="icon" /></header>',
        "<header><math/><svg><style/><path d='M0 0'/></svg></header>",
        "<header><canvas></canvas><object data=x></object></header>",
    ],
)
def test_story_after_an_element(before):
    page = f"<html><body>{before}{STORY}</body></html>"
    assert texts(page)[-3:] == LINES
    assert html_text.main_text(page, html_text.trained()).split("\n") == LINES


def test_text_within_elements():
    assert texts("<p>where <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds.") == ["where E=mc2 holds."]
    b = html_text.blocks("<article><p>a<object><p>fallback</p></object><canvas>drawn</canvas><svg><text>label</text><style>.a{}</style></svg></article><div><select><option>x<option>y</select></div>")
    assert [x.text for x in b] == ["a", "fallback", "drawn", "label", "x", "y"]
    assert [e[0] for e in b[3].chain][-2:] == ["svg", "text"] and [e[0] for e in b[5].chain] == ["div", "select", "option"]


def test_raw_elements_stay_out():
    assert texts("<title>t</title><p>a<script>x<p></script><style/>p{}</style><textarea><p>b</textarea><iframe><p>c</iframe><noscript><p>d</noscript><p>e") == ["a", "e"]
