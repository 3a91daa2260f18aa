"""The main text of pages of many shapes, each written by hand and held against its whole text."""

import pytest

from loamgraph.llm import html

P1, P2, P3 = "The river rose slowly through the night, and by morning the lower fields were gone.", "Nobody in the village had seen such a flood, though the old books speak of two.", "When the water fell, the bridge still stood."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 The Valley Times. All rights kept.</footer>"
AD = "<div class='ad'><a href='#'>Buy boots today, half price</a></div>"
SIDE = "<aside class='sidebar'><h3>Related</h3><ul><li><a href='/1'>One more story</a></li><li><a href='/2'>Another</a></li></ul></aside>"
COMMENTS = "<section class='comments'><h3>Comments</h3><div class='comment'><p>First to say so, and I was there as well.</p></div></section>"
COOKIE = "<div class='cookie-notice'><p>We keep cookies to make this site work better for you.</p><button>Fine</button></div>"
SEARCH = "<form class='search'><input name='q'><button>Go</button></form>"
ALL = ["A flood", P1, P2, P3]
PS = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


SHAPES = {
    "article": (page(f"{NAV}<article><h1>A flood</h1>{PS}</article>{FOOT}"), ALL),
    "article_sections": (page(f"{NAV}<article><h1>A flood</h1><section><h2>Night</h2><p>{P1}</p></section><section><h2>Day</h2><p>{P2}</p><p>{P3}</p></section></article>{FOOT}"), ["A flood", "Night", P1, "Day", P2, P3]),
    "main_section": (page(f"{NAV}<main><section><h2>Night</h2><p>{P1}</p><p>{P2}</p></section></main>{FOOT}"), ["Night", P1, P2]),
    "nested_divs": (page(f"{NAV}<div id='page'><div class='wrap'><div class='content'><h1>A flood</h1><div><p>{P1}</p><p>{P2}</p></div><div><p>{P3}</p></div></div></div></div>{FOOT}"), ALL),
    "body_only": (page(f"{NAV}<h1>A flood</h1>{PS}{FOOT}"), ALL),
    "bare_body": (page(f"<h1>A flood</h1>{PS}"), ALL),
    "body_unclosed": (page(f"<h1>A flood</h1><p>{P1}<p>{P2}<p>{P3}"), ALL),
    "plain_text": (page(f"{P1} {P2}"), [f"{P1} {P2}"]),
    "plain_text_breaks": (page(f"{P1}<br><br>{P2}"), [f"{P1} {P2}"]),
    "no_tags": (f"{P1}\n{P2}", [f"{P1} {P2}"]),
    "plain_div": (page(f"{NAV}<div><h1>A flood</h1>{PS}</div>{FOOT}"), ALL),
    "plain_section": (page(f"{NAV}<section><h1>A flood</h1>{PS}</section>{FOOT}"), ALL),
    "advert_inside": (page(f"{NAV}<article><h1>A flood</h1><p>{P1}</p>{AD}<p>{P2}</p><p>{P3}</p></article>{FOOT}"), ALL),
    "related_inside": (page(f"{NAV}<article><h1>A flood</h1><p>{P1}</p><div class='related'><h3>More</h3><ul><li><a href='/x'>Other floods</a></li></ul></div><p>{P2}</p><p>{P3}</p></article>{FOOT}"), ALL),
    "form_inside": (page(f"{NAV}<article><h1>A flood</h1><p>{P1}</p><form class='newsletter'><p>Get our letter</p><input name='mail'><button>Yes</button></form><p>{P2}</p><p>{P3}</p></article>{FOOT}"), ALL),
    "sidebar": (page(f"{NAV}{SIDE}<main><h1>A flood</h1>{PS}</main>{FOOT}"), ALL),
    "comments_after": (page(f"{NAV}<article><h1>A flood</h1>{PS}</article>{COMMENTS}{FOOT}"), ALL),
    "comments_in_main": (page(f"{NAV}<main><h1>A flood</h1>{PS}{COMMENTS}</main>{FOOT}"), ALL),
    "cookie_first": (page(f"{COOKIE}{NAV}<article><h1>A flood</h1>{PS}</article>{FOOT}"), ALL),
    "search_in_header": (page(f"<header><div>The Valley Times</div>{SEARCH}</header>{NAV}<article><h1>A flood</h1>{PS}</article>{FOOT}"), ALL),
    "list": (page(f"{NAV}<article><h1>A flood</h1><p>{P1}</p><ul><li>Fields under water</li><li>Roads cut off</li></ul><p>{P2}</p></article>{FOOT}"), ["A flood", P1, "Fields under water", "Roads cut off", P2]),
    "table": (page(f"{NAV}<article><h1>A flood</h1><p>{P1}</p><table><tr><td>Monday night</td><td>3 m</td></tr><tr><td>Tuesday</td><td>4 m</td></tr></table></article>{FOOT}"), ["A flood", P1, "Monday night", "3 m", "Tuesday", "4 m"]),
    "quote": (page(f"{NAV}<article><h1>A flood</h1><p>{P1}</p><blockquote><p>{P2}</p></blockquote><p>{P3}</p></article>{FOOT}"), ALL),
    "links_in_text": (page(f"{NAV}<article><h1>A flood</h1><p>The <a href='/river'>river</a> rose slowly through the <em>night</em>.</p><p>{P2}</p></article>{FOOT}"), ["A flood", "The river rose slowly through the night.", P2]),
    "formula": (page(f"{NAV}<article><h1>A flood</h1><p>Let <math><mi>x</mi></math> be the height.</p><p>{P2}</p></article>{FOOT}"), ["A flood", "Let x be the height.", P2]),
    "references": (page(f"{NAV}<article><h1>A &amp; B</h1><p>Salt &lt; water &#233;t&#xe9;</p><p>{P2}</p></article>{FOOT}"), ["A & B", "Salt < water été", P2]),
    "script_and_style": (page(f"{NAV}<article><style>p{{}}</style><h1>A flood</h1><script>var a='<p>no</p>';</script>{PS}</article>{FOOT}"), ALL),
    "comment_in_markup": (page(f"{NAV}<article><h1>A flood</h1><!-- <p>not this</p> -->{PS}</article>{FOOT}"), ALL),
    "no_head": (f"<article><h1>A flood</h1>{PS}</article>", ALL),
    "unclosed_bold": (page(f"{NAV}<article><h1>A flood</h1><p><b>{P1}<p>{P2}</p><p>{P3}</article>{FOOT}"), ALL),
    "menu_as_div": (page(f"<div class='menu'><a href='/'>Home</a> <a href='/n'>News</a> <a href='/a'>About</a></div><div class='post'><h1>A flood</h1>{PS}</div><div class='footer'>All rights kept.</div>"), ALL),
    "breadcrumbs": (page(f"{NAV}<div class='breadcrumbs'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></div><article><h1>A flood</h1>{PS}</article>{FOOT}"), ALL),
    "layout_table": (page(f"<table><tr><td><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/a'>About</a></li></ul></td><td><h1>A flood</h1>{PS}</td></tr></table>"), ALL),
    "deep_sections": (page(f"{NAV}<main><article><section><div><section><h2>Night</h2><p>{P1}</p></section><section><h2>Day</h2><p>{P2}</p></section></div></section></article></main>{FOOT}"), ["Night", P1, "Day", P2]),
    "only_chrome": (page(f"{NAV}{AD}{FOOT}"), []),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", list(SHAPES))
def test_shape(name):
    markup, want = SHAPES[name]
    assert html.default_model().extract(markup).split("\n\n") == (want or [""])
