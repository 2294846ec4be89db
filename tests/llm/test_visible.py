import time

import pytest

from helixframe.llm import html_text

DEEP = "<div>" * 3000
HTML = [
    ("a <math><mi>x</mi><annotation>\\x</annotation></math> <svg><title/><path d='M0'/><text>label</text></svg> b", "a x label b"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<noscript>no scripts</noscript><object>no plugin</object>", "no scriptsno plugin"),
    ("<head><title>t</title>Hello<p>World", "Hello\n\nWorld"),
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no<img alt=no></div>", "yes"),
    ("<div style='display:none'>no<span style='visibility:visible'>no</span></div>yes", "yes"),
    (f"{DEEP}<script>no</script><style>no</style><p style='display:none'>no</p><p>a<p>b", "a\n\nb"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td rowspan=0 colspan=2>a<td>b<tr><td>c</table>", "a |  | b\n  |  | c"),
    ("<ul>" * 3000 + "<li>x", "  " * 511 + "- x"),
]


@pytest.mark.parametrize(("html", "text"), HTML)
def test_all_visible_text(html, text):
    assert html_text.extract_text(html) == text


MORE = [
    ("<form><input type=submit value='Send it'> <input value=Ann> <input placeholder='Your town'> <input type=hidden value=no><input type=password value=no></form>", "Send it Ann Your town"),
    ("<span style='display:block'>b1</span><span style='display:block'>b2</span>", "b1\nb2"),
    ("<div style='display:inline'>b1</div><div style='display:inline'>b2</div>", "b1b2"),
    ("<style>.h{display:none} #g , p.x{ color:red; display: none }/* .v{display:none} */ @media print{.v{display:none}} .b{display:block}</style><i class=h>no</i><i id=g>no</i><p class='x'>no</p><b class='v x'>yes</b><b class=b>own line</b>", "yes\nown line"),
    ("<style>.h{visibility:hidden}</style><div class=h>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<details><summary>more</summary>no<p>no</details><details open><summary>less</summary>yes</details>", "more\nless\nyes"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "  3. a\n  2. b\n  1. c".replace("  ", "")),
    ("<ol type=a start=26><li>a<li>b</ol><ol type=I><li>x<li value=4>y</ol>", "z. a\naa. b\n\nI. x\nIV. y"),
    ("<textarea><b>x</b> &amp; y</textarea><xmp><i>&amp;</i></xmp>", "<b>x</b> & y<i>&amp;</i>"),
    ("a<!-- no > no -->b<!-->c<!x>d<?php no?>e</>f", "abcdef"),
    ("1 < 2 <3 &#99999999999999999999; &#x41; &#0000000000066; a<b", "1 < 2 <3 � A B a<b"),
    ("<a href=\"x>text</a> more", "text more"),
    ("<a href='p'>t</a href='q'>u<svg><![CDATA[<in>]]></svg>", "tu<in>"),
    ("x<script>if (a</script >y", "xy"),
    ("<p>ok</p><!-- open <p>no", "ok"),
    ("<table><tr><td colspan=900>a<td>b<tr><td>c</table>", "a |  | b\nc"),
]


@pytest.mark.parametrize(("html", "text"), MORE)
def test_more_of_the_page(html, text):
    assert html_text.extract_text(html) == text


BROKEN = ["<a ", "<a href=\"", "<a href='x ", "<", "</", "</a", "<!--", "<!", "<![CDATA[", "<svg><![CDATA[", "&#", "&#1", "&", "<style>.a{", "<style>/*", "<style>@a{", "<script>", "</p>", "<p x=", "<a b", "<a k=\"x>\" ",
          "<table><tr><td>x", "<table><tr><td colspan=1000 rowspan=9>x", "<tr><td rowspan=70000>", "<div>x", "<ul><li>x", "<b class='a b c'>", "<textarea>", "<title>", "<td colspan=1000>x", "a ", "\x00", "<details>", "<ol reversed><li>"]


@pytest.mark.parametrize("piece", BROKEN)
def test_time_grows_with_the_page(piece):
    took = {}
    for size in (50_000, 1_000_000):
        start = time.process_time()
        html_text.extract_text("<p>ok</p>" + piece * (size // len(piece)))
        took[size] = time.process_time() - start
    assert took[1_000_000] < 25 and took[1_000_000] < 60 * took[50_000] + 2


def test_unclosed_tags_are_text():
    assert html_text.extract_text("<p>ok</p>" + "<a " * 3) == "ok\n\n<a <a <a"
