import pytest

from quillgate.sources.html import page_elements

CASES = [
    ('<label>Wrapped <b>twice</b> <input name="a"></label>', [("field", "a", "Wrapped twice")]),
    ('<label for="i">By <i>name</i></label><p>x</p><input id="i" name="a">', [("field", "a", "By name")]),
    ('<input name="a" aria-label="Aria"><span>before</span><input name="b">', [("field", "a", "Aria"), ("field", "b", "before")]),
    ('<div id="d">Described <b>here</b></div><p>far</p><input name="a" aria-describedby="d">', [("field", "a", "Described here")]),
    ('<p>' + "long " * 30 + '</p><input name="a">', [("field", "a", None)]),
    # only the element right before counts, not any earlier text
    ("<p>far</p><div><input name='a'></div>", [("field", "a", None)]),
    ("<p>near</p><button name='a'>Own</button><select name='b'><option>one<option>two</select>", [("field", "a", "near"), ("field", "b", "Own")]),
    ("<button name='a'>Own text</button>", [("field", "a", "Own text")]),
    ('<div contenteditable="false" name="a">x</div><div contenteditable="true" name="b">y</div><div role="combobox" name="c">z</div><div role="radio" name="d"></div><a name="e">no href</a>', [("field", "b", "x"), ("field", "d", "z")]),
    ("<script>var a = '<input name=z>';</script><style>p{}</style><textarea name='t'></textarea>", [("field", "t", None)]),
]


@pytest.mark.parametrize("html,want", CASES)
def test_fields_and_labels(spark, html, want):
    rows = page_elements(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.element, r.name, r.label) for r in rows] == want


def test_paths_media_and_backgrounds(spark):
    html = """<html><body><div><form><p>one<p><input name="x"><input name="y" id="a:b c"></form></div>
      <ul><li style="background:url('li.png'); width: 29px; height:50px">a<li style='background: url("big.png"); width:30px'><a href="/q">go</a></ul>
      <object data="data:text/plain,abc" aria-label="Doc"></object><svg/><p style="background:url(p.png)">no place</p><input type="file" role="up" title="T"><img src="data:image/png;base64,AA" alt="A">"""
    rows = page_elements(spark.createDataFrame([(1, html), (None, None), (2, "<a href='/'")], "page_id long, html string")).collect()
    way = {r.name or r.tag: r.selector_path for r in rows if r.element == "field"}
    assert way["x"] == "html > body > div > form > p:nth-of-type(2) > input:nth-of-type(1)" and way["y"] == "#a\\:b\\ c" and way["a"] == "html > body > ul > li:nth-of-type(2) > a"
    media = [(r.tag, r.role, r.alt, r.src) for r in rows if r.element == "media"]
    assert media == [("object", "media", "Doc", "data:[inline]"), ("svg", "media", None, None), ("input", "up", None, None), ("img", "media", "A", "data:[inline]"), ("li", "background_image", None, "big.png")]
    assert {(r.tag, r.role, r.input_type) for r in rows if r.element == "field"} == {("input", "input", "text"), ("a", "link", None), ("input", "up", "file")}
