import pytest

from docloom.parse import html_main, html_markdown, html_text, html_tree


def md(html):
    tree = html_tree.parse(html)
    return html_markdown.markdown(tree, html_tree.root(tree))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>Harbour</h2><h3>Quay</h3><h5>Mooring</h5>", "## Harbour\n\n### Quay\n\n##### Mooring"),
        ("<p><b>tide</b>, then <strong>wind</strong></p>", "**tide**, then **wind**"),
        ("<p>six<b> knots </b>north</p>", "six **knots** north"),
        ("<p>The <i>old </i>pier.</p>", "The *old* pier."),
        ("<p><s>sold</s> <strike>lent</strike> <del>lost</del></p>", "~sold~ ~lent~ ~lost~"),
        ("<p><i><b>loud</b></i></p>", "***loud***"),
        ("<p>Run <code>tar -x</code> twice.</p>", "Run `tar -x` twice."),
        ("<pre><code>for x in y:\n    go(x)</code></pre>", "```\nfor x in y:\n    go(x)\n```"),
        ("<pre>col  col\n row</pre>", "```\ncol  col\n row\n```"),
        ("<p>dusk</p><hr><p>dawn</p>", "dusk\n\n-----\n\ndawn"),
        ("<p>12 Mill Lane<br>Ely</p>", "12 Mill Lane  \nEly"),
        ('<p>as <a href="https://maps.test/ely">mapped</a> then</p>', "as [mapped](https://maps.test/ely) then"),
        ('<p><img src="data:image/gif;base64,R0lG" alt="dot"></p>', ""),
        ('<p><img src="boat.jpg"></p>', "![Image](boat.jpg)"),
        ('<p><a href="https://maps.test"><img src="pin.gif" alt="Pin"></a></p>', "[![Pin](pin.gif)](https://maps.test)"),
        ("<ol><li>cast off</li><li>row</li></ol>", "1. cast off\n2. row"),
        ("<ul><li>rope</li><li>oar</li><li>tar</li></ul>", "- rope\n- oar\n- tar"),
        ("<ul>\n<li>Bow\n<ul><li>stem</li><li>knee</li></ul>\n</li><li>Stern</li></ul>", "- Bow\n  - stem\n  - knee\n- Stern"),
        ("<ul><li>Steps\n<ol><li>sand</li><li>paint</li></ol></li></ul>", "- Steps\n1. sand\n2. paint"),
        ("<table><tr><td>left</td><td>right</td></tr></table>", "left right"),
        ("<blockquote><p>ebb</p><p>flow</p></blockquote>", "> ebb\n> \n> flow"),
        ("<blockquote><p>she said</p><blockquote><p>he wrote</p></blockquote></blockquote>", "> she said\n> > he wrote"),
        ("<p>salt<script>while (1 < 2) '</p>';</script>water</p>", "saltwater"),
        ("<span><div>" * 300 + "keel" + "</div></span>" * 300, "keel"),
        ("<html><body><p>aboard</p></body></html><p>overboard</p>", "aboard"),
        ("<p>port<p>star<b>board", "port\n\nstar**board**"),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert md(html) == want


def test_data_table():
    html = "<table><thead><tr><th>Vessel</th><th>Tons</th></tr></thead><tbody><tr><td>Sloop</td><td>14</td></tr><tr><td>x|y</td></tr></tbody></table>"
    assert md(html).split("\n") == ["|Vessel|Tons|", "|------|----|", "|Sloop|14|", "|x\\|y||"]


def _back(ref, mark="^"):
    return f'<a href="#{ref}">{mark}</a>'


@pytest.mark.parametrize("wrapped", [True, False])
def test_footnotes(wrapped):
    """Two notes that link back, in a marked section or in a bare list after a rule."""
    mark = lambda n: f'<sup><a href="#gloss{n}" id="at{n}">{n}</a></sup>'
    notes = f'<ol><li id="gloss1"><p>A flat boat. {_back("at1")}</p></li><li id="gloss2"><p>Now dry. {_back("at2")}</p></li></ol>'
    tail = f'<section class="footnotes">{notes}</section>' if wrapped else f"<hr>{notes}"
    assert md(f"<p>The punt{mark(1)} crossed the fen{mark(2)} slowly.</p>{tail}") == "The punt[^1] crossed the fen[^2] slowly.\n\n[^1]: A flat boat.\n\n[^2]: Now dry."


def test_links_that_do_not_come_back_are_no_footnotes():
    got = md('<ol><li><a href="#locks">4</a> Locks</li><li><a href="#weirs">9</a> Weirs</li></ol><h3 id="locks">Locks</h3><p>They lift boats.</p><h3 id="weirs">Weirs</h3><p>They do not.</p>')
    assert "[^" not in got and "### Locks" in got and "### Weirs" in got


def test_text():
    tree = html_tree.parse("<div><h1>T</h1><p>a  b<br>c</p><ul><li>x</li><li> y </li></ul><table><tr><td>1</td><td></td><td>2</td></tr></table><nav>no</nav></div>")
    assert html_text.text(tree) == "T\n\na b\nc\n\nx\n\ny\n\n1 | 2\n\n"


def test_main_content():
    story = "<p>" + "A long sentence, with commas, that says something. " * 8 + "</p>"
    tree = html_tree.parse(f"<body><nav>menu</nav><article>{story}</article><footer>end</footer></body>")
    node, gone, tier = html_main.select(tree)
    assert tier == "semantic" and tree.tag[node] == "article" and len(gone) == 2
    tree = html_tree.parse(f"<body><div class='sidebar'>x</div><div id='wrap'><div class='post-body'>{story}{story}</div><div><p>short</p></div></div></body>")
    node, gone, tier = html_main.select(tree)
    assert tier == "scored" and tree.attrs[node].get("class") == "post-body"
    tree = html_tree.parse("<body><nav>only furniture</nav><nav>only furniture</nav><nav>only furniture</nav></body>")
    assert html_main.select(tree)[2] == "whole"


def test_references_without_their_end():
    """A named reference is whole or is text, also in attributes; numbers need no end; raw text stays."""
    tree = html_tree.parse('<p title="a&amp b&lt;">x &amp</p><p>&amp;&copy;&ampere;&nosuch; &#65 &am</p><script>a&amp b&amp;</script>')
    assert [t for t, k in zip(tree.text, tree.kind, strict=True) if k == "text"] == ["x &amp", "&\u00a9&ampere;&nosuch; A &am"]
    assert tree.attrs[1] == {"title": "a&amp b<"}
    assert [t for t, k in zip(tree.text, tree.kind, strict=True) if k == "raw"] == ["a&amp b&amp;"]
