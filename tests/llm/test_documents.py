import hashlib
import random

import pytest

from scalewright.llm import html_text, merkle, warc
from scalewright.llm.common import shared_dir

from .helpers import corpus, frame


def test_tree_keeps_the_text_and_locates_edits():
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choice(["alpha", "beta.", "gamma,", "delta"]) + str(rng.randrange(99)) for _ in range(40)) for _ in range(30))
    a = merkle.tree(text)
    assert a.size == len(text) + 1 and merkle.tree(text).hash == a.hash and merkle.tree(text + " ").hash != a.hash
    at = text.index("beta", 3000)
    b = merkle.tree(text[:at] + "X" + text[at + 1 :])
    found = merkle.edits(a, b)
    assert found and all(start <= at < start + size + 500 for start, size in found) and sum(s for _, s in found) < 500
    assert 0.8 < merkle.likeness(a, b) < 1 == merkle.likeness(a, a) and merkle.likeness(a, merkle.tree("other words")) < 0.1
    assert merkle.likeness(merkle.tree(""), merkle.tree("")) == 1


def plain_root(text):
    """The root by the rules as the module states them, written out: sentences, lines, sections, text."""
    digest = lambda level, parts: hashlib.sha256(bytes([level]) + b"".join(parts)).digest()
    leaf = lambda t: digest(0, [t.encode()])
    sections, open_one = [], []
    for line in text.split("\n") if text else []:
        cut, start = [], 0
        for k in range(1, len(line)):
            if line[k].isspace() and not (line[k - 1].isalnum() or line[k - 1] == "_" or line[k - 1].isspace()):
                cut.append(line[start : k + 1])
                start = k + 1
        cut = [c for c in [*cut, line[start:]] if c]
        assert all(len(c) <= merkle.LONG_LEAF for c in cut)
        paragraph = digest(1, [leaf(c) for c in cut] + [leaf("\n")])
        open_one.append(paragraph)
        if line == "" or paragraph[0] % 8 == 0:
            sections.append(digest(2, open_one))
            open_one = []
    return digest(3, sections + ([digest(2, open_one)] if open_one else [])).hex()


def plain_likeness(a, b):
    """Share of characters in equal lines of two texts of one section each, none of which repeats; both without long parts."""
    left, right = a.split("\n"), b.split("\n")
    return sum(2 * (len(x) + 1) for x in set(left) & set(right)) / (len(a) + len(b) + 2)


def test_trees_equal_plain_ones():
    rng = random.Random(9)
    for _ in range(200):
        text = "\n".join(" ".join(f"w{rng.randrange(50)}" + rng.choice(["", "", ".", ",", "!"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(9)))
        assert merkle.fingerprint(text) == plain_root(text)
    lines = [f"word{k}" for k in range(60)]
    lines = [x for x in lines if bytes.fromhex(plain_root(x))[0] is not None and hashlib.sha256(b"\x01" + hashlib.sha256(b"\0" + x.encode()).digest() + hashlib.sha256(b"\0\n").digest()).digest()[0] % 8]
    for _ in range(100):
        a, b = ("\n".join(rng.sample(lines, 6)) for _ in range(2))
        common = set(a.split("\n")) & set(b.split("\n"))
        got = merkle.likeness(merkle.tree(a), merkle.tree(b))
        # The newline's own leaf is alike in lines that differ.
        assert abs(got - plain_likeness(a, b) - 2 * (6 - len(common)) / (len(a) + len(b) + 2)) < 1e-12


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        a, b, c = merkle.tree(text), merkle.tree(edited), merkle.tree(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hash.hex(), b.hash.hex(), merkle.likeness(a, b), merkle.likeness(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("rows", [corpus(), corpus()[:1], [(i, f"text {i}. and more") for i in range(50)], [(None, "a"), (None, "b")], []])
def test_fingerprints_equal_plain_ones(spark, rows):
    got = merkle.fingerprints(frame(spark, rows).selectExpr("*", "1 AS fingerprint"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows)


def pages():
    big = "<p>" + "x" * 1200 + "\r\n\r\né</p>"
    rows = [(1, "http://a.org/1", big), (5, "http://a.org/5", big), (3, None, big), (2, "u", "small"), (4, "u\r\nX: 1", "small"), (6, "v", None), (7, "v", ""), (8, "w", "ends\r\n"), (9, "w", "\r\n\r\n"), (None, "n", big), (11, "k", "y" * 1000), (11, "k", "y" * 1000), (12, "WARC/1.1", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello")]
    return rows


def test_archive_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in pages()], "page_id long, url string, html string, payload string")
    path = f"{shared_dir(spark)}/archive"
    warc.write_archive(df, path)
    warc.export_files(spark, path, f"{path}_files")
    imported = warc.import_files(spark, f"{path}_files")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(imported).collect()), key=repr)
    want = []
    for i, _, t in pages():
        data = (t or "").encode()
        same = [j for j, _, x in pages() if (x or "") == (t or "") and j is not None]
        owner = max(same, default=None)
        revisit = len(data) >= 1000 and owner is not None and i != owner
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    assert got == sorted(want, key=repr)
    stored = [bytes(r.payload) for r in warc.read_payloads(spark, path).collect()]
    assert len(stored) == len(set(stored)) == len({t or "" for _, _, t in pages()})
    records = warc.rebuild(spark, path).collect()
    assert sorted(bytes(r.payload or b"") for r in records) == sorted((t or "").encode() if w[3] == "response" else b"" for (_, _, t), w in zip(pages(), want, strict=True))
    again = sorted((r.header, bytes(r.payload)) for r in imported.collect())
    split = [bytes(r.record).split(b"\r\n\r\n", 1) for r in records]
    assert again == sorted((h.decode(), b[:-4]) for h, b in split)


def test_damage_is_noticed(spark):
    path = f"{shared_dir(spark)}/archive"
    warc.write_archive(spark.createDataFrame(pages()[:2], "page_id long, url string, html string"), path)
    bad = f"{path}_bad"
    warc.read_headers(spark, path).select("page_id", "header", "payload_key").write.parquet(f"{bad}/headers")
    warc.read_payloads(spark, path).selectExpr("payload_key", "CAST('other' AS binary) AS payload").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.rebuild(spark, bad).collect()
    empty = f"{path}_empty"
    warc.read_headers(spark, path).select("page_id", "header", "payload_key").write.parquet(f"{empty}/headers")
    warc.read_payloads(spark, path).limit(0).write.parquet(f"{empty}/payloads")
    with pytest.raises(Exception, match="no payload for"):
        warc.rebuild(spark, empty).collect()
    warc.export_files(spark, path, f"{path}_files")
    revisits = warc.import_files(spark, f"{path}_files").filter("record_type = 'revisit'")
    with pytest.raises(Exception, match="no payload for page 1"):
        warc.read_records(revisits).collect()


def test_empty_archive(spark):
    path = f"{shared_dir(spark)}/archive"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    warc.export_files(spark, path, f"{path}_files")
    assert warc.read_records(warc.import_files(spark, f"{path}_files")).count() == 0


def test_broken_markup():
    page = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>H</header><div class='site-menu'>m</div><div id=content><p>One <b>bold</b>&nbsp;x<p>Two<br>line &lt;b&gt; &eacute;<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- no --><div class=\"comments\"><p>reader</p></div></div><form><label>q</label></form><script>var a='<p>x</p>';</script><p>tail"
    assert html_text.main_text(page, set()) == "One bold x\n\nTwo line <b> é\n\na\n\nb\n\nc\n\nd\n\ntail"
    assert html_text.main_text("", set()) == "" and html_text.main_text("plain  text", set()) == "plain text"
    article = "<body><nav>n</nav><article><header><h1>Title</h1></header><p>text</p><aside>side</aside><footer>by</footer></article><p>outside</p></body>"
    assert html_text.main_text(article, set()) == "Title\n\ntext"


def test_template_of_a_host_is_deduced(spark):
    page = lambda k: f"<html><body><div class='top'><span>Site name</span><a>Home</a><a>About</a></div><div class='box'><p>Story {k} begins here.</p><p>It has a second part {k * 7}.</p></div><div class='end'><i>Written by us</i><u>since 1999</u></div></body></html>"
    rows = [(k, f"http://host.org/{k}", page(k)) for k in range(6)] + [(100, "http://lonely.org/", page(9)), (101, None, None), (102, "http://host.org/x", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for k in range(6):
        assert got[k].text == f"Story {k} begins here.\n\nIt has a second part {k * 7}." and got[k].n_chars == len(got[k].text)
    assert "Story 9 begins here." in got[100].text and got[101].text == "" and got[102].text == ""
    assert html_text.extract(df.limit(0)).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(k, f"http://host.org/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def test_text_beside_an_article_is_judged_by_the_template(spark):
    page = lambda k: f"<body><div class='top'><a>Home</a><a>About</a></div><div class='story'><p>Story {k} begins.</p><p>It ends at {k * 7}.</p></div><article>Teaser {k}</article></body>"
    got = texts_of(spark, [page(k) for k in range(6)])
    assert got == {k: f"Story {k} begins.\n\nIt ends at {k * 7}.\n\nTeaser {k}" for k in range(6)}


def test_repeated_notices_in_articles_go_and_quotes_stay(spark):
    page = lambda k: f"<body>Loose words<article><h1>Title {k}</h1><p>Body {k} here.</p><p>{'A quoted line.' if k < 3 else f'Own line {k}.'}</p><p>Get our app today.</p><p class='x'>Prices may change.</p></article></body>"
    got = texts_of(spark, [page(k) for k in range(8)])
    assert got == {k: f"Title {k}\n\nBody {k} here.\n\n{'A quoted line.' if k < 3 else f'Own line {k}.'}" for k in range(8)}


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><article><h1>Title</h1><p>Same body.</p></article><div class='s'><p>One.</p><p>Two.</p></div></body>"
    assert set(texts_of(spark, [page] * 5).values()) == {"Title\n\nSame body.\n\nOne.\n\nTwo."}


@pytest.mark.parametrize("open_tag", ["<div class='content has-sidebar'>", "<div id='main' class='no-sidebar'>", "<div class='search-result'>", "<article><div class='article-header'>", "<h2 class='section-header'>", "<article><p class='notice'>", "<p class='notice'>", "<body class='with-comments'>"])
def test_names_that_say_something_else(open_tag):
    assert html_text.main_text(f"{open_tag}Main text", set(), set()) == "Main text"


@pytest.mark.parametrize("open_tag", ["<div class='x sidebar'>", "<div class='site-menu'>", "<div class='comment-list'>", "<ul id=comments>", "<article><article class='comment'>", "<article class='comment'>", "<article><div class='ad-2'>", "<div class='footer-links'>", "<div class='notice'>"])
def test_names_of_other_parts(open_tag):
    assert html_text.main_text(f"{open_tag}Other text", set(), set()) == ""


def test_names_vote_with_the_template(spark):
    page = lambda k: f"<body><article><p class='notice'>{'Same notice.' if k < 4 else f'News {k}.'}</p><p class='lead'>{'A quote.' if k < 4 else f'Lead {k}.'}</p></article></body>"
    got = texts_of(spark, [page(k) + f"<i>{k}</i>" for k in range(12)])
    assert got == {k: f"A quote.\n\n{k}" if k < 4 else f"News {k}.\n\nLead {k}.\n\n{k}" for k in range(12)}
