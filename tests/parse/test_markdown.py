import pytest

from docloom.parse import html_markdown, html_tree
from docloom.parse.commonmark import definitions
from docloom.parse.markdown_html import to_html
from docloom.parse.markdown_runs import chapters, runs, title


@pytest.mark.parametrize(
    ("markdown", "want"),
    [
        ("# Marsh", "<h1>Marsh</h1>"),
        ("##### Reed", "<h5>Reed</h5>"),
        ("Rain.\n\nThen sun.", "<p>Rain.</p>\n<p>Then sun.</p>"),
        ("**bold** __b__ *i* ***both*** ~~s~~ `x`", "<p><strong>bold</strong> <strong>b</strong> <em>i</em> <em><strong>both</strong></em> <del>s</del> <code>x</code></p>"),
        ("[Ely](https://maps.test/ely)", '<p><a href="https://maps.test/ely">Ely</a></p>'),
        ("![A reed](reed.gif)", '<p><img src="reed.gif" alt="A reed"></p>'),
        ("> so it ran", "<blockquote><p>so it ran</p></blockquote>"),
        ("> [!NOTE]\n> Gate shuts at six", '<aside class="markdown-alert markdown-alert-note" data-alert="note" role="note"><p class="markdown-alert-title">Note</p><p>Gate shuts at six</p></aside>'),
        ("> Tip: try `ls -a` first", '<aside class="markdown-alert markdown-alert-tip" data-alert="tip" role="note"><p class="markdown-alert-title">Tip</p><p>try <code>ls -a</code> first</p></aside>'),
        ("- heron\n- bittern", "<ul><li>heron</li><li>bittern</li></ul>"),
        ("7. north\n8. east", '<ol start="7"><li>north</li><li>east</li></ol>'),
        ("- pack\n  1. tent\n  2. stove\n- walk", "<ul><li>pack<ol><li>tent</li><li>stove</li></ol></li><li>walk</li></ul>"),
        ("- a\n\n- b", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"),
        ("```\nsum = a + b\n```", "<pre><code>sum = a + b</code></pre>"),
        ('```c<&"x\nnil\n```', '<pre><code class="language-c&lt;&amp;&quot;x">nil</code></pre>'),
        ("    go(2)", "<pre><code>go(2)</code></pre>"),
        ("---", "<hr>"),
        ("***", "<hr>"),
        ("Fens\n====", "<h1>Fens</h1>"),
        ("- [ ] dig\n- [x] sow", '<ul><li class="task-list-item"><input type="checkbox" disabled> dig</li><li class="task-list-item"><input type="checkbox" disabled checked> sow</li></ul>'),
        ("a <mark>wet</mark> day", "<p>a &lt;mark&gt;wet&lt;/mark&gt; day</p>"),
        ("at <https://maps.test>;", '<p>at <a href="https://maps.test">https://maps.test</a>;</p>'),
        ("at https://maps.test or so", "<p>at https://maps.test or so</p>"),
        ("Mill Lane  \nEly", "<p>Mill Lane<br>\nEly</p>"),
        ("On [a map][m7] only\n\n[m7]: https://maps.test", '<p>On <a href="https://maps.test">a map</a> only</p>'),
        (r"five \*stars\* given", "<p>five *stars* given</p>"),
        ("reed_bed_two", "<p>reed_bed_two</p>"),
        ("a — b … “q” -- ... \"x\"", "<p>a — b … “q” -- ... \"x\"</p>"),
        ("| a | b |\n|---|:-:|\n| 1 | 2 |", '<table><thead><tr><th>a</th><th style="text-align: center">b</th></tr></thead><tbody><tr><td>1</td><td style="text-align: center">2</td></tr></tbody></table>'),
        ("A dyke[^q].\n\n[^q]: or ditch", '<p>A dyke<sup><a href="#fn-1" id="ref-1">[1]</a></sup>.</p>\n<div class="footnote-definition" id="fn-1"><strong>[1]:</strong> or ditch</div>'),
        ("A fen[^none] lies", "<p>A fen[^none] lies</p>"),
        ("Plain land.\n\n[^spare]: never shown", "<p>Plain land.</p>"),
        ("", ""),
        (None, ""),
    ],
)
def test_html(markdown, want):
    assert to_html(markdown) == want


def test_footnote_order_repeats_and_nesting():
    got = to_html("Eels[^eel] and pike[^pike], more eels[^eel].\n\n[^pike]: long jaws\n[^eel]: they migrate[^sea]\n[^sea]: far west")
    assert 'id="ref-1-2">[1]' in got
    assert got.index("they migrate") < got.index("long jaws") < got.index("far west")
    multi = to_html("Peat[^p] burns.\n\n[^p]: It is cut in spring.\n\n    It dries by autumn.")
    assert '<div class="footnote-definition" id="fn-1"><p><strong>[1]:</strong></p><p>It is cut in spring.</p>\n<p>It dries by autumn.</p></div>' in multi
    assert "<code>[^w]</code>" in to_html("Write `[^w]` as[^w] shown\n\n[^w]: so")


def test_definitions_first_or_last():
    text = "[^a]: one\n[^a]: two\n```\n[^b]: no\n```"
    assert definitions(text)[0] == {"a": "one"}
    assert definitions(text, "last")[0] == {"a": "two"}


def test_raw_and_xhtml():
    assert to_html("a <mark>wet</mark> x < y", raw=True) == "<p>a <mark>wet</mark> x &lt; y</p>"
    assert to_html("a\n\n---\n\n![x](y.png)", xhtml=True) == '<p>a</p>\n<hr />\n<p><img src="y.png" alt="x" /></p>'


@pytest.mark.parametrize("markdown", ["# T\n\nSome *text* with **bold** and `code`.", "- a\n- b\n  - c", "1. x\n2. y", "> quote\n> \n> more", "```\ncode\n```", "A claim[^1] and[^2].\n\n[^1]: First.\n\n[^2]: Second, with *emphasis*.", "see [l](https://e.com/x)"])
def test_round_trip(markdown):
    tree = html_tree.parse(to_html(markdown))
    assert html_markdown.markdown(tree, html_tree.root(tree)) == markdown


def test_runs():
    got = runs("# T\n\na **b *c*** [d](u)\n\n1. x\n2. y")
    assert [(r["text"], r["style"]) for r in got] == [("T", 0), ("a ", 0), ("b ", 1), ("c", 3), (" ", 0), ("d", 0), ("x", 0), ("y", 0)]
    assert got[5]["link"] == "u" and got[7]["path"] == "list:3/item:2/para:1"


def test_chapters_and_title():
    got = chapters("intro\n\n# One\n\n## Sub\n\ntext\n\n# Two\n\nmore")
    assert [(c["title"], c["front"]) for c in got] == [("Untitled", True), ("One: Sub", False), ("Two", False)]
    assert [c["title"] for c in chapters("only text", title="Book")] == ["Book"]
    assert title("```\n# no\n```\n## Yes ##\n") == "Yes"
