"""Small fixtures for each training-data operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from docgrowth.llm import ann, decontam, html, jaccard, langid, packing, pii, stages, tokens, toxicity, urls
from docgrowth.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, sig string, id string, key int"
EN, DE = "the quick brown fox and the lazy dog were there with that thing", "der schnelle braune fuchs und der faule hund waren nicht dort aber hier"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", "y", 2) for i, t, lang in rows], DOCS)


def story(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


# --- personal data


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john [at] example [dot] com now", {"email": ["john [at] example [dot] com"]}),
        ("mail john at example dot com now", {"email": ["john at example dot com"]}),
        ("jоhn@exаmple.com", {"email": ["jоhn@exаmple.com"]}),
        ("call plus four nine one seven six one two three four five", {"phone": ["plus four nine one seven six one two three four five"]}),
        ("one nine two dot one six eight dot zero dot one", {"ip": ["one nine two dot one six eight dot zero dot one"]}),
        ("look at example.com or at noon dot", {}),
        ("a@b.c@d.e", {"email": ["a@b.c"]}),
        ("4111-1111 1111 1111 and 4111 1111 1111 1112", {"card": ["4111-1111 1111 1111"]}),
        ("0001.2.3.255 and 1.2.3.256", {"ip": ["0001.2.3.255"]}),
        ("+1 (456) 555-2186", {"phone": ["+1 (456) 555-2186"]}),
        ("+1 23", {}),
    ],
)
def test_pii_spans_are_of_the_source(text, found):
    _, both = pii.all_spans(text)
    assert {k: [text[s:e] for s, e in v] for k, v in both.items() if v} == found


def test_pii_query_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "x@y.zz " * 3, "en"), (3, "x@y.zz " * 3, "en"), (4, "a" * 200_000 + "@" + "1" * 50_000, "en")]
    got = pii.find_pii(documents(spark, rows).drop("n")).select("doc_id", "pii.*").collect()
    assert sorted((r["doc_id"], r["n_email"]) for r in got) == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 0)]
    assert pii.masked("to x@y.zz!") == "to <EMAIL>!" and pii.masked(None) is None


# --- near copies


def brute_components(texts: dict[int, str | None]) -> dict[int, int]:
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if label[a] < label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return label


def test_near_copies_equal_brute_force(spark):
    r, texts = random.Random(3), {1: None, 2: "", 3: " \t ", 4: "Only Four Words Here", 5: "only four words here", 6: "one two three four five six seven eight nine", 7: "one two three four five six seven eight ten"}
    for k in range(6):
        base = story(k, r.choice([8, 40, 150, 900]))
        for c in range(8):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = "zz" + str(r.random())
            texts[100 * (k + 1) + c] = " ".join(words)
    got = jaccard.near_copies(documents(spark, [(i, t, "en") for i, t in texts.items()])).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == brute_components(texts)
    assert {x["doc_id"]: x["n_shingles"] for x in got if x["doc_id"] < 6} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    assert jaccard.near_copies(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 9, 30, 100, 300, 1000])
def test_similar_sets_share_enough_keys(n):
    rng, bands = np.random.default_rng(n), jaccard.Bands(80)
    for _ in range(30):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, max(0, n // 5 - drop) // 2, dtype=np.uint64)]))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 100 * common >= 80 * union:
            shared = np.intersect1d(jaccard.block_keys(a, bands), jaccard.block_keys(b, bands))
            assert len(shared) >= min(bands.need(len(a)), bands.need(len(b)))
            distance = sum(int(x).bit_count() for x in (jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64))
            assert distance <= union - common


def test_runs_of_keys_across_batches():
    rows = np.array(sorted([(k, s) for k, n in ((1, 1), (2, 2), (3, 40), (4, 1), (5, 17), (6, 16)) for s in range(n)] * 2), np.int64)
    for size in (1, 2, 3, 7, 20, 1000):
        out = list(jaccard.runs_of_keys((rows[k : k + size] for k in range(0, len(rows), size)), 16))
        found = {(int(k), int(s)): bool(c) for r, often in out for (k, s), c in zip(r, often, strict=True)}
        assert len(found) == sum(len(r) for r, _ in out)
        assert found == {(k, s): k in (3, 5) for k, n in ((2, 2), (3, 40), (5, 17), (6, 16)) for s in range(n)}


# --- benchmark passages


def test_decontamination(spark):
    item, short = story(1, 30), story(2, 6)
    changed = list(item)
    changed[7] = changed[19] = "other"
    rows = [(1, " ".join(story(5, 50) + item + story(6, 20)), "en"), (2, " ".join(story(7, 80)), "en"), (3, " ".join(changed).upper(), "en"), (4, None, "en"), (5, "", "en"), (6, " ".join(story(8, 9) + short), "en"), (7, " ".join(item[:11]), "en")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["matched"]) for r in decontam.overlaps(documents(spark, rows), bench).collect()}
    assert got == {(1, 1): (50, 30), (3, 1): (0, 28), (6, 2): (9, 6)}
    kept = stages.not_in_benchmark(documents(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7]
    assert decontam.overlaps(documents(spark, []), bench).count() == 0 and decontam.overlaps(documents(spark, rows), bench.limit(0)).count() == 0


# --- packing and token matrices


@pytest.mark.parametrize("plan", [packing.exact_complements, tokens.best_fit_decreasing])
def test_plans_place_every_piece_once(plan):
    r = random.Random(1)
    for capacity in (1, 7, 64, 4096):
        counts = {n: r.randint(1, 30) for n in range(1, capacity + 1) if r.random() < 0.4 or n == capacity}
        p = plan(counts, capacity)
        fill: dict[int, list] = {}
        for n, first, run, seq, off in zip(p.length, p.first, p.run, p.sequence, p.offset, strict=True):
            later = [f for m, f in zip(p.length, p.first, strict=True) if m == n and f > first]
            for k in range(min(later, default=counts[n]) - first):
                fill.setdefault(int(seq + k // run), []).append((int(off + k % run * n), int(n)))
        assert sum(map(len, fill.values())) == sum(counts.values()) and len(fill) == p.sequences
        for parts in fill.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= capacity
        assert p.sequences <= 1.25 * sum(n * c for n, c in counts.items()) / capacity + 2
    assert plan({}, 10).sequences == 0


def test_exact_complements_find_triples():
    assert packing.exact_complements({5: 1, 2: 1, 1: 2, 9: 1}, 9).sequences == 2


def test_pieces_and_encoder(spark):
    texts = [None, "", "The the, THE. it's x|y ..,", "İstanbul Σας\x1cz <|endoftext|>", "word " * 9000, "é ü ñ"]
    direct = tokens.Encoder(tokenizer_file())
    assert list(tokens.Encoder(tokenizer_file(), limit=2).encode(texts)) == direct._direct([t or "" for t in texts])
    docs = documents(spark, [*((i, t, "en") for i, t in enumerate(texts)), (2, texts[2], "en")])
    got = packing.pack(docs, tokenizer_file()).collect()
    for i, t in enumerate(texts):
        ids = direct._direct([t or ""])[0] + b"\1\0\0\0"
        parts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i})
        assert parts == [(k, 4096 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[s : s + 16384] for s in range(0, len(ids), 16384))]
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    rows = tokens.packed(docs, tokenizer_file(), capacity=64, pad_id=7).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(r["length"] for r in got)
    made: dict[tuple[int, int], list] = {}
    for r in rows:
        ids, position, ends = (np.frombuffer(r["ids"], f"<u{r['id_bytes']}"), np.frombuffer(r["position_ids"], f"<u{r['id_bytes']}"), r["cu_seqlens"])
        assert len(ids) == len(position) == 64 and ends[0] == 0 and ends[-1] == r["n_tokens"] and (ids[ends[-1] :] == 7).all()
        assert position.tolist() == [k for a, b in itertools.pairwise([*ends, 64]) for k in range(b - a)]
        for m, (a, b) in zip(r["members"], itertools.pairwise(ends), strict=True):
            made.setdefault((m["key"], m["piece"]), []).append(ids[a:b].tolist())
    for i, t in enumerate(texts):  # the rows of the matrix hold what encoding each text directly gives
        want = [*direct.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(want), 64):
            assert made.pop((i, k // 64)) == [want[k : k + 64]] * (2 if i == 2 else 1)
    assert not made and tokens.packed(documents(spark, []), tokenizer_file()).count() == 0
    assert packing.pack(documents(spark, []), tokenizer_file()).count() == 0


# --- language, toxicity


def test_language(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(8)] + [(20, None, "en"), (21, "123 !?", "de"), (22, EN.upper(), None), (23, DE * 3000, None)]
    docs = documents(spark, rows)
    model = langid.fit(docs)
    got = {r["doc_id"]: r["language"] for r in langid.predict(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 20, 21, 22, 23)] == ["de", "en", "und", "und", "en", "de"]
    assert got[20]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(docs.limit(0)) is None
    assert {r["language"]["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    one = langid.fit(docs.filter("lang = 'en'"))
    assert langid.predict(docs, one).filter("doc_id = 0").first()["language"]["lang_pred"] == "en"


def test_codewords_differ_in_half_their_bits():
    for n in (2, 3, 4, 9, 40):
        c = langid._codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= c.shape[1] // 3


def test_toxicity_ignores_named_groups(spark):
    r = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = story(1000 + i, 20) + (["idiotic", "stupid"] if bad else ["lovely"]) + ([r.choice(["muslim", "christian"])] if bad and i % 3 else [])
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (5000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    assert model.score("you are stupid and idiotic") >= 0.7 > model.score("a lovely day")
    assert abs(model.score("a muslim wrote this") - model.score("a christian wrote this")) < 0.05
    assert model.score("my muslim neighbour") < 0.7 and model.score(None) == model.score("") < 0.7
    free = toxicity.train([toxicity.words(t) for _, t, _ in rows], np.array([y for _, y in marks]), fairness=0.0)
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("atheist", 0))
    assert gap(model) <= gap(free)
    assert 0 < toxicity.fit(documents(spark, []), labels).score("x") < 1


# --- urls, pages, neighbours


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7x?q"), (4, "http://x.com/en/1#t"), (5, "https://example.net/de/8"), (6, "https://net/de/1"), (7, "http://badcom/en/1"), (8, "http://x.org/es/"), (9, "http://"), (9, "http://")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[4] == ("x.com", "/en/1", "com/en/", "block")
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow") and got[7][2:] == (None, "allow") and got[8][2:] == ("org/es/", "block")


def test_url_templates_learn_and_merge(spark):
    rows = [(i, f"http://h.com/en/{i}") for i in range(20)] + [(100 + i, f"http://h.com/en/{i}.html") for i in range(20)]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string")).select("template", "blocked", "labelled").distinct().collect()
    assert [tuple(r) for r in got] == [("/en/*", 40, 40)]
    mixed = [(i, f"http://h.com/en/{i}") for i in range(40)] + [(100 + i, f"http://h.com/fr/{i}") for i in range(10)] + [(200 + i, f"http://h.org/es/{i}") for i in range(3)] + [(300 + i, f"http://h.org/en/{i}") for i in range(30)]
    judged = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(mixed, "page_id int, url string")).collect()}
    # Most of h.com is labelled, and blocked; of h.org a few pages are, which say little about the rest.
    assert {(judged[100 + i]["template"], judged[100 + i]["verdict"], judged[100 + i]["rule"]) for i in range(10)} == {("/+/*", "block", None)}
    assert {(judged[300 + i]["template"], judged[300 + i]["verdict"]) for i in range(30)} == {("/+/*", "allow")}


def test_branches_that_differ_beyond_chance_stay_apart(spark):
    rules = (urls.Rule("h.com", "/bad/", "block"), urls.Rule("h.com", "/good/", "allow"))
    rows = [(i, f"http://h.com/bad/{i}") for i in range(50)] + [(100 + i, f"http://h.com/good/{i}") for i in range(50)] + [(200, "http://h.com/new/1")]
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string"), rules=rules).collect()}
    assert got[0] == ("/bad/*", "block") and got[100] == ("/good/*", "allow") and got[200] == ("/+/*", "allow")


def test_urls_long_empty_and_clashing(spark):
    deep = "http://h.com/" + "a/" * 5000
    rows = spark.createDataFrame([(1, deep, "x", 1), (2, "http://h.com/" + "b" * 200_000, "y", 2), (3, "http://h.com/en/1", "z", 3)], "page_id int, url string, host string, blocked int")
    got = {r["page_id"]: r for r in urls.judge(rows).collect()}
    assert got[1]["path"] == deep[len("http://h.com") :] and len(got[2]["path"]) == 200_001 and got[3]["verdict"] == "block"
    assert urls.judge(rows.limit(0)).count() == 0


def test_urls_without_labels_are_allowed(spark):
    rows = spark.createDataFrame([(k, f"http://h.de/{k}") for k in range(5)], "page_id int, url string")
    assert {r["verdict"] for r in urls.judge(rows).collect()} == {"allow"}


def test_wide_nodes_are_variable(spark):
    wide = spark.createDataFrame([(i, f"http://h.net/user/{'abcdefghijklmnopqrstuvwxyz'[i]}/home") for i in range(26)], "page_id int, url string")
    assert [r["template"] for r in urls.judge(wide).select("template").distinct().collect()] == ["/user/*/home"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text &amp; more", "plain text & more"), ("<article><p>a<b>b</b> c<br>d<p>e</article><footer>x</footer>", "ab c d e"),
        ("<script>var t='</p>';</script><p>x<!-- no --> y</p><style>p{}</style>", "x y"), ("<nav>m</nav><div class='ad'>z</div><main><h1>T</h1><div class=comments>no</div><p>b</p></main>", "T b"),
        ("<article><p>open<script>never closed", "open"), ("<article>a &am", "a &am"), ("<aside>s</aside><form>f<input></form><div>k</div>", "k"), ("<p>a <b>b</p><p>c", "a b c"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content no-sidebar'><p>a</p></div>", "a"), ("<main class='with-sidebar'>a</main>", "a"), ("<article class='post share'>a</article>", "a"),
        ("<div id='search-results'>a</div>", "a"), ("<body><form><p>a long text</p></form><p>b</p></body>", "a long text b"), ("<p title='the hidden valley'>a</p>", "a"),
        ("<div class='page-header-layout'>a</div><p hidden>b</p><p style='display: none'>c</p>", "a"), ("<div class='sidebar wrapper'><article>a</article></div><div class='related'>b</div>", "a"), ("<p>a<span class='share'>x</span>b</p>", "ab"),
    ],
)
def test_marks_on_wrappers_keep_the_text(page, text):
    assert html.main_text(page) == text


def test_recurring_branches_of_a_host_go(spark):
    pages = [(i, f"http://h.com/{i}", f"<div class=top>Same everywhere</div><div class=body>text number {i} of the page</div>") for i in range(12)]
    got = html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    assert all(r["main_text"] == f"text number {r['page_id']} of the page" for r in got)
    copies = [(i, "http://h.com/x", "<div class=top>Same</div><article>one article</article>") for i in range(9)]
    assert {r["main_text"] for r in html.extract(spark.createDataFrame(copies, "page_id int, url string, html string")).collect()} == {"one article"}


def test_a_recurring_text_or_copies_do_not_cut_what_is_below(spark):
    pages = [(i, f"http://h.com/{i}", f"<body>Skip to content<div class=body><p>text number {i}</p></div></body>") for i in range(8)]
    pages += [(100 + i, f"http://g.com/{i}", f"<body><p>page {max(0, i - 40)}</p></body>") for i in range(46)]
    got = {r["page_id"]: r["main_text"] for r in html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {i: f"text number {i}" for i in range(8)} | {100 + i: f"page {max(0, i - 40)}" for i in range(46)}


def test_importance_decides_inside_and_outside_articles(spark):
    pages = [(i, f"http://h.com/{i}", f"<main><div class=box>All rights reserved</div><p>main text {i}</p></main>") for i in range(9)]
    pages += [(100 + i, f"http://g.com/{i}", f"<article class=card>Read this too</article><div class=body>body text {i}</div>") for i in range(9)]
    got = {r["page_id"]: r["main_text"] for r in html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {i: f"main text {i}" for i in range(9)} | {100 + i: f"body text {i}" for i in range(9)}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(600, 16)), np.repeat(rng.normal(size=(1, 16)), 200, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [0.0] * 16), (1001, [float("nan")] * 16), (1100, [1.0] * 3), (1002, [None, *[1.0] * 15])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    queries = {r["query_id"] for r in got}
    assert queries == {0, 100, 200, 300, 400, 500, 600, 700}
    hits = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        found = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(found) == 10 and found == sorted(found, key=lambda v: (d[v], v))
        hits += len(set(found) & set(want.tolist()))
    assert hits >= 0.9 * 10 * len(queries)
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 700), key=lambda r: r["rank"])] == list(range(600, 610))
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert len(few) == 2 and ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(story(9, 60))
    rows = [(5, text, "en"), (3, text, "en"), (3, text, "en"), (9, "alone", "en"), (10, None, "en"), (11, "", "en")]
    kept = stages.one_of_each_group(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 9, 10, 11]

