"""Main-text extraction on pages written by hand, none of them from the generator or the fixtures."""

import pytest

from shelfmark.llm import html_extract

P = "The town lies on the river and has many old houses. People come to see the market on Saturdays."
Q = "In winter the bridge is closed, and the ferry runs twice a day between both banks of the river."
PAGES = [
    ("main-pre", f"<main><p>{P}</p><pre>make all\nmake install</pre><p>end.</p></main>", [P,"make all make install","end."]),
    ("div-h1", f"<div><h1>Town</h1><p>{P}</p><p>{Q}</p></div>", ["Town",P,Q]),
    ("body-bare", f"<html><body><h1>Town</h1><p>{P}</p><p>Yes.</p><p>{Q}</p></body></html>", ["Town",P,"Yes.",Q]),
    ("article-header", f"<body><nav><a href=/>Home</a> <a href=/a>News</a></nav><article><header><h1>Town</h1></header><p>{P}</p><p>{Q}</p></article><footer>&copy; 2020 Us</footer></body>", ["Town",P,Q]),
    ("divs", f"<body><div><div>{P}</div><div>{Q}</div><div>{P}</div></div></body>", [P,Q,P]),
    ("sections", f"<body><div><section><h2>One</h2><p>{P}</p></section><section><h2>Two</h2><p>{Q}</p><ul><li>first</li><li>second</li></ul></section></div></body>", ["One",P,"Two",Q,"first","second"]),
    ("menu-div", f"<body><div class=menu><a href=/>Home</a> <a href=/b>About</a></div><div><h1>Town</h1><p>{P}</p><pre>x = 1</pre><p>{Q}</p></div><div class=footer>&copy; 2020 Us</div></body>", ["Town",P,"x = 1",Q]),
    ("code-doc", f"<body><main><h1>Guide</h1><p>Run:</p><pre><code>pip install it\nit --help</code></pre><p>{P}</p><h2>Use</h2><p>{Q}</p><pre>it run</pre></main></body>", ["Guide","Run:","pip install it it --help",P,"Use",Q,"it run"]),
    ("short", f"<body><article><p>One.</p><p>Two words.</p><p>{P}</p></article><aside><h3>More</h3><a href=/1>Other</a></aside></body>", ["One.","Two words.",P]),
    ("quote", f"<body><div><h1>Town</h1><p>{P}</p><blockquote>{Q}</blockquote><p>So it was.</p></div><div class=comments><p>Nice one</p></div></body>", ["Town",P,Q,"So it was."]),
    ("table", f"<body><main><h1>Sizes</h1><p>{P}</p><table><tr><td>Length</td><td>5 m</td></tr><tr><td>Width</td><td>2 m</td></tr></table><p>{Q}</p></main></body>", ["Sizes",P,"Length","5 m","Width","2 m",Q]),
    ("h4", f"<div><h4>Notes</h4><p>{P}</p><h4>More</h4><p>{Q}</p></div>", ["Notes",P,"More",Q]),
    # Written after the generator was last changed.
    ("login", f"<body><form><label>Name</label><input><button>Go</button></form><div><h2>Town</h2><p>{P}</p><p>{Q}</p></div></body>", ["Town", P, Q]),
    ("list-first", f"<main><ol><li>{P}</li><li>{Q}</li></ol><p>Done.</p></main>", [P, Q, "Done."]),
    ("dialog", f"<body><div class='cookie-banner'><p>We use cookies. <a href=/c>More</a></p></div><div id=content><h1>Town</h1><p>{P}</p><pre>a\nb</pre><p>Bye.</p></div></body>", ["Town", P, "a b", "Bye."]),
    ("nested", f"<div><div><div><h1>Town</h1><p>{P}</p><h3>Winter</h3><p>{Q}</p></div></div></div>", ["Town", P, "Winter", Q]),
    ("refs", f"<main><p>{P} See <a href=/x>the list</a> &amp; more.</p><script>if (a) b('</p>')</script><p>{Q}</p></main>", [P + " See the list & more.", Q]),
    ("long", "<main>" + f"<p>{P}</p><pre>x</pre>" * 3000 + "</main>", [P, "x"] * 3000),
]


@pytest.mark.parametrize("name,page,want", PAGES, ids=[p[0] for p in PAGES])
def test_layouts(name, page, want):
    assert html_extract.extract([page], html_extract.train())[0] == "\n".join(want)
