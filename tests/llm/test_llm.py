"""Each operator against a plain version, and on odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlake.llm import components, decontaminate, html_text, jaccard, katz, neighbours, pii, quality, queries, repeats, sentence_pieces, token_counts
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, one word, repeated row, null id, very long word and text."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "same text here"), (5, "same text here"), (None, "lost id"), (7, "x" * 30_000), (8, "word " * 30_000), (9, "É ü\x85　日本 😀 a\x00b")]
    return documents(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("n_words", F.lit("clash")).withColumn("block", F.lit("clash"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])


# ---- 1 --------------------------------------------------------------------------------------------------------------


def base_spans(text):
    """The plain forms by regular expression, as they are defined."""
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15)
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans():
    r = random.Random(3)
    parts = ["a@b.c", "x.y@mail-1.example.com.", "@", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6468", "+1 (663) 555-6869", "+49 30 1234567890123", "+", "..", "word", " ", "-", "12", "é", "\n"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(t) == base_spans(t), t
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_pii_model_finds_held_out_examples():
    crf, hit, said, there = pii.trained(), 0, 0, 0
    for row in pii.examples(200, seed=1234):
        text, spans = pii.spelled(row)
        got = {(s, e, pii.KINDS[k]) for s, k, e in pii.model_spans(crf, [text])[0]}
        hit, said, there = hit + len(got & set(spans)), said + len(got), there + len(spans)
    assert hit / said > 0.9 and hit / there > 0.9


def test_pii_spelled_out_without_digits():
    """Forms without a digit or an at sign are decoded as well; plain prose with the same marks and words stays."""
    crf = pii.trained()
    for before, span, after in (("write to ", "jane.doe [at] example.com", ""), ("mail ", "jane [at] example.org", ", please"), ("or ", "jane_doe (at) mail.example.net", " today")):
        text = f"a line first\n{before}{span}{after}"
        at = len("a line first\n") + len(before)
        assert pii.all_spans(crf, [text, None, ""]) == ([[], [], []], [[(at, 0, at + len(span))], [], []])
        assert pii.masked(text, pii.all_spans(crf, [text])[1][0]) == f"a line first\n{before}[email]{after}"
    prose = ["clean text only", "meet me at example.com tomorrow", "look (at) the house", "he arrived at noon. then left", "at at at at at at", "she said (in short) no.", "file_name and other.name [see below]"]
    assert pii.all_spans(crf, prose)[1] == [[] for _ in prose]


def test_pii_viterbi_is_the_best_path():
    crf, r = pii.trained(), random.Random(5)
    for _ in range(5):
        s, n = pii.lanes([[r.randrange(crf.k) for _ in range(4)]], 0)
        e, got = crf.emissions(s)[0], crf.viterbi(s, n)[0]
        value = lambda y, e=e: crf.begin[y[0]] + sum(e[t, y[t]] for t in range(4)) + sum(crf.move[y[t], y[t + 1]] for t in range(3))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=value)
        assert math.isclose(value(tuple(got)), value(best))


def test_pii_rows_and_masks(spark, odd):
    docs = documents(spark, [(1, "mail me: a.b@c.de or +1 (663) 555-6869."), (2, None), (3, "clean text only")])
    r = {x["doc_id"]: x for x in pii.find(docs).collect()}
    assert (r[1]["n_email"], r[1]["n_phone"], r[2]["spans"], r[3]["spans"]) == (1, 1, "", "")
    assert r[1]["base_sha256"] == hashlib.sha256(b"email:9:17,phone:21:38").hexdigest()
    m = {x["doc_id"]: x for x in pii.mask(docs).collect()}
    assert m[1]["text"] == "mail me: [email] or [phone]." and m[1]["n_chars"] == len(m[1]["text"]) and m[2]["text"] is None and m[3]["text"] == "clean text only"
    assert pii.mask(docs).columns == docs.columns
    assert pii.find(odd).count() == odd.count() and pii.find(odd.limit(0)).count() == 0


HAND = [
    ("Ring me at 020 7946 0958 after six.", ["phone:020 7946 0958"]),
    ("Office: (030) 901-8200, ask for the porter", ["phone:(030) 901-8200"]),
    ("please write to jane.doe [at] example.com", ["email:jane.doe [at] example.com"]),
    ("joe at example dot com is what I use", ["email:joe at example dot com"]),
    ("paid with 4111.1111.1111.1111 on friday", ["card:4111.1111.1111.1111"]),
    ("The meeting at noon was moved, dot your i and cross your t.", []),
    ("In 1998 we sold 3,500 units for $12.50 each", []),
    ("version 2.10.3 came out on 12.05.2021", []),
    ("see chapter 3 (pages 45-67) of the book", []),
    ("arrived at 10:45, left at 11:30", []),
]


@pytest.mark.parametrize(("line", "want"), HAND)
def test_pii_by_hand(line, want):
    """Lines labelled by hand, not by the rule that makes the training table."""
    assert [f"{pii.KINDS[k]}:{line[a:z]}" for a, k, z in pii.all_spans(pii.trained(), [line])[1][0]] == want


def test_pii_skips_only_lines_without_a_better_path(spark):
    """Lines that the bound leaves out have no label under Viterbi either."""
    crf = pii.trained()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]]
    texts += [pii.spelled(x)[0] for x in pii.examples(100, 3)]
    shapes = pii.Shapes(crf)
    coded = [c for t in texts for line in t.split("\n") if (c := b"".join(shapes[w] for w in line.split()))]
    assert all(shapes[w] == bytes(crf.ids(pii.TOKEN.findall(w))) for t in texts[:20] for w in t.split())
    hope, marked = crf.hopeful(coded), 0
    for c, h in zip(coded, hope, strict=True):
        got = crf.viterbi(*pii.lanes([c], 0)).any()
        marked += got
        assert h or not got
    assert marked and not hope.all()


def test_pii_many_spans_in_one_text():
    text = "a@b.cd (555) 123-4567 " * 3000
    base, full = pii.all_spans(pii.trained(), [text])
    assert len(base[0]) == 3000 and len(full[0]) > 3000


# ---- 2 --------------------------------------------------------------------------------------------------------------


def contamination(docs, items):
    def cut(t):
        return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(ASCII_LOWER)) if w]

    wins = {i: {tuple(w[p : p + min(10, len(w))]) for p in range(len(w) - min(10, len(w)) + 1)} for i, t in items if (w := cut(t))}
    out = {}
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for i, ws in wins.items():
            for x in ws:
                for p in range(len(w) - len(x) + 1):
                    if tuple(w[p : p + len(x)]) == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_decontamination(spark, broadcast_rows):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["Aa", "b", "c'", "dÉ", "e!"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((12, 30, 10, 9, 3, 1, 11, 11))] + [(8, None), (9, ""), (10, "!!"), (12, "one two three"), (13, None)]
    items.append((11, items[0][1]))
    docs = [(i, text(r.randint(0, 120))) for i in range(30)] + [(30, items[1][1] + " X " + items[0][1]), (31, None), (32, ""), (33, "One, TWO three!"), (34, "zz " * 5000)]
    got = decontaminate.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id LONG, text STRING"), broadcast_rows=broadcast_rows).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"]) for x in got} == contamination(docs, items)
    assert all(x["contaminated"] == (x["n_hit"] > 0) for x in got)


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([(1, "same text here"), (None, "one")], "item_id LONG, text STRING")
    got = decontaminate.contaminated(odd, items).collect()
    assert len(got) == odd.count() and sum(x["n_items"] for x in got) == 2
    assert decontaminate.contaminated(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0
    assert sorted(x["doc_id"] for x in decontaminate.clean(odd, items).where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 7, 8, 9]


# ---- 3 --------------------------------------------------------------------------------------------------------------


def removed(docs, window):
    first, out = {}, {}
    for d, t in docs:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, d), d)
    for d, t in docs:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("chars", "split"), [(10**6, 20_000), (300, 20_000), (300, 1)])
def test_repeats(spark, chars, split):
    r = random.Random(4)
    stock = [[r.choice("abcdef") for _ in range(40)] for _ in range(6)]
    docs = []
    for i in range(40):
        w = [r.choice("uvwxyz") for _ in range(r.randint(0, 15))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(stock)
            w += s[r.randint(0, 10) : r.randint(20, 40)]
        docs.append((i * 3, " ".join(w)))
    docs += [(500, docs[3][1]), (501, "a " * 200), (502, "a " * 100), (503, None), (504, "")]
    want = removed(docs, 8)
    got = repeats.deduplicated(documents(spark, docs), window=8, block_chars=chars, split=split).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["text"]) for x in got} == want
    got = repeats.digests(documents(spark, docs), window=8, block_chars=chars, split=split).collect()
    assert {x["doc_id"]: x["kept_sha256"] for x in got} == {d: hashlib.sha256(v[2].encode()).hexdigest() for d, v in want.items()}


def test_repeats_odd(spark, odd):
    got = repeats.digests(odd).collect()
    assert len(got) == odd.count() and sum(x["n_removed"] for x in got) == 0
    assert repeats.digests(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("alphabet", "n", "window"), [(2, 300, 50), (1, 120, 50), (3, 200, 7), (1000, 80, 50)])
def test_suffix_tree(alphabet, n, window):
    """The order of suffixes cut at the window, and where neighbours part, against plain comparison."""
    r = random.Random(n)
    base = [r.randrange(alphabet) for _ in range(n // 2)]
    h = np.array(base + base[: n - len(base)], np.uint64)
    suffix = np.arange(0, n - window + 1)
    order, depth = repeats.suffix_tree(h, suffix, window)
    cut = [tuple(h[i : i + window].tolist()) for i in order]
    assert cut == sorted(cut) and sorted(order.tolist()) == suffix.tolist()
    for i in range(1, len(cut)):
        same = next((k for k in range(window) if cut[i][k] != cut[i - 1][k]), window)
        assert depth[i] == same


# ---- 4 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [10**6, 100])
def test_neighbours(spark, cell):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x[100:140] = x[100]  # equal vectors: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, []), (904, [1.0]), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("rank", F.lit("clash"))
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, cell=cell).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    y, hit = x.astype(float), 0
    assert sorted(got) == list(range(0, 800, 20))
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21)) and q not in [v for v, _ in found.values()]
        assert all(math.isclose(s, y[v] @ y[q], abs_tol=1e-12) for v, s in found.values())
        s = y @ y[q]
        s[q] = -np.inf
        hit += len({v for v, _ in found.values()} & set(np.lexsort((np.arange(800), -s))[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.9
    assert [got[100][i][0] for i in range(1, 21)] == list(range(101, 121))


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    assert [(r["vec_id"], r["rank"]) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") == 99).count() == 0


# ---- 5 --------------------------------------------------------------------------------------------------------------


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for p in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert p["text"] == "\n\n".join(b for b in blocks if b) and p["n_chars"] == len(p["text"])


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, ""), ("", ""), ("<p>x", "x"), ("only text", "only text"), ("<nav>menu</nav>", ""), ("<script>var a='<p>no</p>'</script><p>yes</p>", "yes"), ("<div><p>a &lt;b&gt;\n c</p><aside>no</aside><p>d</p></div><footer>f</footer><foo", "a <b> c\n\nd"), ("<article><h1>T</h1><p>one two three</p><section class='comments'><p>spam spam spam spam spam</p></section></article><div class='cookie-notice'>ok</div>", "T\n\none two three"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep")],
)
def test_html_odd(page, want):
    assert html_text.main_text(page) == want


LONG = "<p>This paragraph is one of several that are all about as long as an article's paragraphs are.</p>"


@pytest.mark.parametrize(
    ("body", "lost"),
    [
        (f"<nav>menu</nav><h1>Title</h1><div class=post>{LONG * 5}</div><div class=post>{LONG * 3}</div><footer>foot</footer>", "menu foot"),
        (f"<div class=head><h1>Title</h1></div><div>{LONG * 5}</div><ul><li><a href=x>other</a></li><li><a href=y>page</a></li></ul><div><div>{LONG * 3}</div></div>", "other page"),
        (f"<h1>Title</h1><h2>Sub</h2><div class=post>{LONG * 5}</div><h2>Part</h2><section>{LONG * 2}</section><h2>Links</h2><ul><li><a href=x>other</a></li></ul>", "Links other"),
        (f"<div class=post>{LONG * 5}</div>A stretch of <b>text</b> right in the body, which is about as long as one of the paragraphs in the post is.<div class=post>{LONG * 2}</div>", ""),
    ],
)
def test_html_articles_in_pieces(body, lost):
    """Pages without article or main: what is as dense as the article beside it, and the headings, stay."""
    got = html_text.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>")
    whole = " ".join(re.sub("<[^>]*>", " ", body).split())
    for w in lost.split():
        assert w not in got.split()
        whole = " ".join(x for x in whole.split() if x != w)
    assert " ".join(got.split()) == whole


@pytest.mark.parametrize("wrapper", ["div class='content'", "div class='no-sidebar content'", "div class='layout has-sidebar'", "div class='post social-ready'", "div class='wrap with-nav'", "div class='article-body comments-open'", "div class='related-news story'", "div id=sidebar-layout", "div class=menu", "form action=x"])
def test_html_names_weigh_only(wrapper):
    """A wrapper's names don't cost the article, while named parts in and beside it go."""
    tag = wrapper.split()[0]
    page = f"<body><div class=topbar>top words</div><{wrapper}><h1>Title</h1>{LONG * 3}<div class=comments>{LONG * 2}</div>{LONG * 2}<div class='share-buttons'><a href=x>share it</a></div></{tag}><div class='cookie-notice'>We use them</div></body>"
    one = re.sub("<[^>]*>", "", LONG)
    assert html_text.main_text(page) == "\n\n".join(["Title"] + [one] * 5)
    twice = page.replace(f"</{tag}><div class='cookie", f"</{tag}><{wrapper}>{LONG * 2}</{tag}><div class='cookie")
    if tag == "div":
        assert html_text.main_text(twice) == "\n\n".join(["Title"] + [one] * 7)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "clash"), (1, "u", "<p>a</p>", "clash"), (None, None, None, None)], "page_id LONG, url STRING, html STRING, text STRING")
    assert sorted(x["text"] for x in html_text.extract(df).collect()) == ["", "a", "a"] and html_text.extract(df.limit(0)).count() == 0


# ---- 6 --------------------------------------------------------------------------------------------------------------


def jaccard_components(docs):
    sets = {}
    for d, t in docs:
        w = words((t or "").translate(ASCII_LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("few", "reps", "chars", "hot", "work"), [(None, None, 10**6, None, None), (None, None, 2000, None, None), (1, 1, 2000, None, 0), (2, 1, 2000, 3, 1)])
def test_jaccard(spark, monkeypatch, few, reps, chars, hot, work):
    """With production settings, and with small ones that make crowds, dealt shingles and several turns."""
    for name, value in (("FEW", few), ("REPS", reps), ("HOT_BITS", hot), ("WORK", work), ("PIVOTS", reps)):
        if value is not None:
            monkeypatch.setattr(jaccard, name, value)
    r = random.Random(6)
    base = [[r.choice("abcdefghijklmnop") for _ in range(60)] for _ in range(5)]
    docs = []
    for i in range(90):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = f"w{r.randrange(1000)}"
        docs.append((i, " ".join(w[r.randint(0, 3) :])))
    docs += [(200, "A b C"), (201, "a B c"), (202, None), (203, ""), (204, "a b"), (205, "x y z u v"), (206, "x y z u v w"), (207, docs[0][1])]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.joined(documents(spark, docs), block_chars=chars).collect()}
    assert got == jaccard_components(docs)


def test_jaccard_hidden_members_of_a_crowd(spark):
    """Groups R+X / R+Y: the R+Y documents link with each other only, and neither hold their group's first id nor are in the first REPS groups."""
    ids = [x["id"] for x in spark.range(400).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).collect()]  # of one block
    r, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("r", 14), ("x", 27), ("y", 27)))
    docs, groups = [], jaccard.FEW + jaccard.REPS
    for i in range(groups):
        own = [f"own{i}_{k}" for k in range(3)]
        docs.append((ids[i], " ".join(own + r + x)))
        if i >= jaccard.REPS:
            docs.append((ids[groups + i], " ".join(own + r + y)))
    # others make X and Y frequent, so that prefixes are of R
    docs += [(ids[2 * groups + i], " ".join(r[-4:] + x + r[-4:] + y + [f"z{i}_{k}" for k in range(80)])) for i in range(24)]
    want = jaccard_components(docs)
    assert groups > jaccard.FEW and len({c for _, c in want.values()}) == 2 + 24
    got = {z["doc_id"]: (z["n_shingles"], z["component_id"]) for z in jaccard.joined(documents(spark, docs)).collect()}
    assert got == want


def test_jaccard_crowds_of_groups_in_several_components(spark, monkeypatch):
    """d2 stands in a group with d1, whose component e is in already; only d2 itself links the two with e's rest."""
    r, docs = random.Random(9), []
    at = iter(r.sample(range(10_000), 400))
    for k in range(30):
        x, a, b = ([f"{c}{k}_{i}" for i in range(n)] for c, n in (("x", 160), ("a", 40), ("b", 40)))
        a, b = ["a", *a], ["b", *b]
        docs += [(next(at), " ".join(x + a + [f"r{k}_{i}"])) for i in range(6)]
        docs += [(next(at), " ".join(x + a)), (next(at), " ".join(x + b)), (next(at), " ".join(x + a[:20] + b[20:] + [f"e{k}"]))]
    want = jaccard_components(docs)
    for few, reps in ((jaccard.FEW, jaccard.REPS), (2, 1)):
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "REPS", reps)
        got = {z["doc_id"]: (z["n_shingles"], z["component_id"]) for z in jaccard.joined(documents(spark, docs), block_chars=200_000).collect()}
        assert got == want


def test_jaccard_odd(spark, odd):
    got = jaccard.joined(odd).collect()
    assert len(got) == odd.count() and all(x["component_id"] == x["doc_id"] for x in got)
    assert jaccard.joined(odd.limit(0)).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (50, 60)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a LONG, b LONG")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 50: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


# ---- 7 and 8 ----------------------------------------------------------------------------------------------------------


def strange_texts():
    r = random.Random(1)
    letters = "abe 'tTsS  \n\t\x85\xa0 éß²½́١日本_-!.,12<|>\x1c😀▁"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|> b<|endoftext|>", "", None, "a" * 5000, "ab" * 3000, " " * 300, "<s></s><unk><0x41>"]


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    texts = strange_texts()
    path = queries.tokenizer("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {x["doc_id"]: x for x in token_counts.token_counts(documents(spark, list(enumerate(texts))), path).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(x["over_limit"] == (x["n_tokens"] > 512) for x in got.values())
    assert token_counts.token_counts(odd, path).count() == odd.count() and token_counts.token_counts(odd.limit(0), path).count() == 0


def test_sentence_pieces(spark, odd):
    import sentencepiece

    texts = strange_texts()
    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentence_pieces.encode(documents(spark, list(enumerate(texts))), path)
    got = {x["doc_id"]: x["ids"] for x in encoded.collect()}
    want = sp.encode([t or "" for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    back = {x["doc_id"]: x["text"] for x in sentence_pieces.decode(encoded, path).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]
    digest = {x["doc_id"]: x for x in sentence_pieces.encode_digest(odd.where("doc_id = 9"), path).collect()}
    assert digest[9]["round_trip"] and digest[9]["ids_sha256"] == hashlib.sha256(np.array(sp.encode("É ü\x85　日本 😀 a\x00b"), "<i4").tobytes()).hexdigest()
    assert sentence_pieces.encode(odd, path).count() == odd.count() and sentence_pieces.encode(odd.limit(0), path).count() == 0
    assert sentence_pieces.decode(spark.createDataFrame([(1, None), (2, [1, 31999])], "doc_id LONG, ids ARRAY<INT>"), path).count() == 2


# ---- 9 --------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert ((out["predicted"] == out["quality"]).mean() > 0.95) and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 1), (8, None), (None, 1)], "doc_id LONG, quality INT")
    gam = quality.learn(odd, labels)
    assert quality.score(odd, gam).count() == odd.count() and quality.score(odd.limit(0), gam).count() == 0
    none = quality.learn(odd, labels.limit(0))
    assert {x["score"] for x in quality.score(odd, none).collect()} == {0.5}
    assert quality.keep_good(odd, none).columns == odd.columns and quality.keep_good(odd, none).count() == 0


def test_quality_pairs_learn_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    gam = quality.fit(x, y)
    assert ((gam.score(x) > 0.5) == y).mean() > 0.9


# ---- 10 -------------------------------------------------------------------------------------------------------------


def katz_scores(docs):
    toks = [[*words((t or "").translate(ASCII_LOWER)), None] for _, t in docs]
    train = [d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in docs]
    uni, bi, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for ts, on in zip(toks, train, strict=True):
        if on:
            uni.update(ts)
            bi.update(zip([None, *ts[:-1]], ts, strict=True))
    for h, w in bi:
        after[h].add(w)
    n, v = sum(uni.values()), len(uni)

    def discount(c):
        m = collections.Counter(c.values())
        a, d = (6 * m[6] / m[1] if m[1] else 1), {}
        for r in range(1, 6):
            x = ((r + 1) * m[r + 1] / m[r] / r - a) / (1 - a) if m[r] and a < 1 else 1
            d[r] = x if 0 < x < 1 else 1.0
        return lambda c: d.get(c, 1.0)

    du, db = discount(uni), discount(bi)
    lost = sum((1 - du(c)) * c for c in uni.values()) / max(1, n)
    unknown, scale = (lost, 1.0) if lost > 1e-15 else (1 / (n + 1), n / (n + 1))
    p1 = lambda w: scale * du(uni[w]) * uni[w] / n if uni[w] else unknown
    total = collections.Counter()
    for (h, _), c in bi.items():
        total[h] += c

    def p2(h, w):
        if not total[h]:
            return p1(w)
        keep = sum(db(bi[h, x]) * bi[h, x] for x in after[h]) / total[h]
        shrink = total[h] / (total[h] + 1) if 1 - keep < 1e-12 else 1.0
        if bi[h, w]:
            return db(bi[h, w]) * bi[h, w] / total[h] * shrink
        return (1 - keep * shrink) / (1 - sum(p1(x) for x in after[h])) * p1(w)

    rows = [(len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p2(h, w)) for h, w in zip([None, *t[:-1]], t, strict=True))) for t in toks]
    return rows, p2, [*uni, "never seen"]


@pytest.mark.parametrize("chars", [10**7, 400])
def test_katz(spark, chars):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["The", "a", "b", f"w{r.randrange(60)}"]) for _ in range(r.randint(0, 25)))) for i in range(60)] + [(100, None), (101, "")]
    want, p2, vocabulary = katz_scores(docs)
    for h in (None, "the", "w1"):
        assert math.isclose(sum(p2(h, w) for w in vocabulary), 1, rel_tol=1e-9)  # exactly normalised
    got = {x["doc_id"]: x for x in katz.scores(documents(spark, docs), block_chars=chars).collect()}
    for (d, _), (n, known, train, base, score) in zip(docs, want, strict=True):
        x = got[d]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n, known, train)
        assert math.isclose(x["base_score"], base, rel_tol=1e-9) and math.isclose(x["score"], score, rel_tol=1e-9)


def test_katz_odd(spark, odd):
    got = katz.scores(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(x["score"]) for x in got)
    assert katz.scores(odd.limit(0)).count() == 0
