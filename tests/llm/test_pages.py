"""Main text of web pages: pages whose article is known, and the tree's importances against their definition."""

import math
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("basalt.llm")

from basalt.llm import site_style  # noqa: E402

SCHEMA = "page_id long, url string, html string, text string, low int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "k") for i, u, h in rows], SCHEMA).repartition(3)


def main_text(page):
    return site_style.joined([(b, t) for _, b, t in site_style.parts(page)[0]])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("a &amp; b &lt;c&gt; &#233;&nbsp;&euro;&unknown; &amp", "a & b <c> é €&unknown; &"),
        ("<p>one\n\t two<p>three<b>four</b>five<br>six", "one two\n\nthreefourfive six"),
        ("<article><h1>T</h1><p><b>a<br><p>b</p></article><footer>f", "T\n\na\n\nb"),
        ("<nav>n</nav><main><p>a</p><aside>s</aside></main><p>outside</p>", "a"),
        ("<body class='has-sidebar no-comments'><div class='page with-sidebar'><article class='post'>a<div class='shareBar'>x</div></article></div><div id=comments><article class=comment>c</article></div>", "a"),
        ("<main><div class=post><p>real text of the page</p></div><section class=related><article>teaser</article></section></main>", "real text of the page"),
        ("<script>var a='<p>x</p>';</script><style>p{}</style><p>a<!-- <p>b</p> -->c</p><script>never ends", "ac"),
        ("<p title='a > b'>x</p><a href=\"y\"\">z</a>", "x\n\nz"),
        ("<p>1 < 2 and <3</p>", "1 < 2 and <3"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc d\n\ne"),
        ("<div hidden>h</div><div style='display: none'>i</div><div aria-hidden=true>j</div><p>a</p><form><p>f</p></form><button>b</button>", "a"),
        ("<form id=f><p>" + "long text " * 9 + "</p><input></form><p>x</p>", ("long text " * 9).strip() + "\n\nx"),
        ("<header><h1>site</h1></header><article><header><h1>head</h1></header>a<footer>f</footer></article>", "head\n\na"),
        ("<p>a</p><unfinished ", "a"),
        ("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"),
        ("</p></div>a</b>", "a"),
        ("<p></p>  <p>&nbsp;</p>", ""),
    ],
)
def test_pages_of_known_text(page, text):
    assert main_text(page) == text


def site(rng, host, count, named):
    """Pages whose article is known; the site's parts have classes that say nothing."""
    out = []
    for i in range(count):
        blocks = [" ".join(f"w{rng.randint(0, 5_000)}" for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(2, 6))]
        body = "".join(f"<p>{b.replace(' ', rng.choice([' ', chr(10), '  ']))}</p>" for b in blocks)
        body = f"<article>{body}</article>" if named else f"<div class=x3>{body}</div>"
        page = f"<html><body><div class=x1><span>Home</span> <span>About us</span></div>{body}<div class=x2><p>All rights reserved by us</p><i>{rng.choice(['one', 'two'])}</i></div></body></html>"
        out.append((f"https://{host}/{i}", page, "\n\n".join(blocks)))
    return out


def test_site_parts_go(spark):
    rng = random.Random(6)
    rows = [*site(rng, "a.example", 40, False), *site(rng, "b.example", 12, True)]
    same = rows[0]
    rows += [(f"https://a.example/copy{i}", *same[1:]) for i in range(60)]  # a third and more of the pages are one page
    few = site(rng, "c.example", 3, False)
    pages = [(i, u, h) for i, (u, h, _) in enumerate([*rows, *few])] + [(None, None, None), (7, "no address", "<p>x</p>"), (8, "https://a.example", ""), (8, "https://a.example", "")]
    got = site_style.extract(frame(spark, pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = Counter((r.page_id, r.url, r.text) for r in got.collect())
    want = Counter((i, u, t) for i, (u, _, t) in enumerate(rows))
    # Three pages are too few to tell a site's parts from its texts: nothing is lost.
    want += Counter((len(rows) + i, u, f"Home About us\n\n{t}\n\nAll rights reserved by us\n\n" + ("one" if "<i>one" in h else "two")) for i, (u, h, t) in enumerate(few))
    want += Counter([(None, None, ""), (7, "no address", "x"), (8, "https://a.example", ""), (8, "https://a.example", "")])
    assert found == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_joined_by_host_where_too_large_to_send(spark, monkeypatch):
    rows = site(random.Random(7), "a.example", 20, False)
    pages = frame(spark, [(i, u, h) for i, (u, h, _) in enumerate(rows)])
    monkeypatch.setattr(site_style, "SENT_BYTES", -1)
    assert {(r.page_id, r.text) for r in site_style.extract(pages).collect()} == {(i, t) for i, (*_, t) in enumerate(rows)}


def test_a_page_keeps_its_article(spark):
    """Near copies of one article on a site: the article is no part of the site."""
    body = "".join(f"<p>sentence number {i} of the article</p>" for i in range(6))
    pages = [(i, f"http://a.example/{i}", f"<body><article>{body}<p>page {i}</p></article></body>") for i in range(30)]
    pages += [(100 + i, f"http://b.example/{i}", f"<body><div>{body}</div><i>{i}</i></body>") for i in range(30)]
    got = {r.page_id: r.text for r in site_style.extract(frame(spark, pages)).collect()}
    assert all(got[i].count("sentence") == 6 for i in range(30))
    assert all(got.values())


def test_empty_table_and_long_page(spark):
    assert site_style.extract(frame(spark, [])).count() == 0
    text = "word " * 600_000
    got = site_style.extract(frame(spark, [(1, "http://a.b/", f"<p>{text}</p>" * 2)])).first()
    assert got.text == f"{text.strip()}\n\n{text.strip()}"


def by_definition(pages):
    """Importances of one host's elements, from the definitions, in plain recursion."""
    trees, seen = [], set()
    for page in pages:
        nodes, leaves, _ = site_style.style_tree(site_style.parts(page)[0])
        digest = tuple(f for *_, f in leaves)
        if digest not in seen:
            seen.add(digest)
            trees.append((nodes, leaves))
    shown, styles, up, tf = defaultdict(set), defaultdict(Counter), {}, defaultdict(Counter)
    for n, (nodes, leaves) in enumerate(trees):
        for key, parent, parent_style, _, style in nodes:
            shown[key].add(n)
            styles[key][style] += 1
            up[key] = parent, parent_style
        for key, style, place, feature in leaves:
            tf[key, style, place, feature][n] += 1

    def entropy(counts, m):
        total = sum(counts)
        return min(1.0, -sum(c / total * math.log(c / total) for c in counts) / math.log(m))

    held = defaultdict(list)
    for key, style, place, feature in tf:
        held[key, style, place].append(tf[key, style, place, feature].values())
    leaf = {k: 1.0 if len(shown[k[0]]) == 1 else 1 - sum(entropy(list(c), len(shown[k[0]])) for c in v) / len(v) for k, v in held.items()}

    def of(key):
        m, own = len(shown[key]), styles[key]
        layout = 1.0 if m == 1 else entropy(list(own.values()), m)
        most, within = 0.0, 0.0
        for style, times in own.items():
            below = [(x, x) for k, x in leaf.items() if k[:2] == (key, style)] + [of(k) for k, p in up.items() if p == (key, style)]
            within += times / sum(own.values()) * sum(x for x, _ in below) / len(below)
            most = max(most, *(x for _, x in below))
        fade = site_style.GAMMA ** len(own)
        imp = (1 - fade) * layout + fade * within
        return imp, max(imp, most)

    return {k: (len(shown[k]), *of(k)) for k in shown}


def test_importances_against_their_definition(spark):
    rng = random.Random(8)
    pages = [h for _, h, _ in site(rng, "a.example", 25, False)]
    pages += [f"<div><p>{rng.choice('abc')}<b>{rng.choice('de')}</b></p><ul>{'<li>x' * rng.randint(1, 3)}</ul>{rng.choice(['', '<i>y</i>'])}</div>" for _ in range(40)]
    got = site_style.importance(site_style.parse(frame(spark, [(i, "http://a.example/", h) for i, h in enumerate(pages)]))).collect()
    want = by_definition(pages)
    assert {r.key for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert (r.pages, r.importance, r.most) == (want[r.key][0], pytest.approx(want[r.key][1]), pytest.approx(want[r.key][2]))
