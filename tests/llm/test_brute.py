"""Operators against plain versions of themselves, on small tables and on the smallest of the given ones."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from docgrowth.llm import ann, decontam, html, langid, pii, queries, toxicity

DATA = "/root/testdata/sf0.001"


def story(seed: int, n: int, letters: str = "abcdefghij") -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n)]


# --- personal data: the base spans by the contract's patterns as they stand


def plain_base(text: str) -> str:
    found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", m.span()))
    found += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return ",".join(f"{kind}:{s}:{e}" for kind, (s, e) in found)


def test_pii_base_equals_the_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op1_pii(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = plain_base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert {*base.split(",")} - {""} <= {*got[i]["spans"].split(",")}
        assert sum(got[i][f"n_{k}"] for k in pii.KINDS) == len([x for x in got[i]["spans"].split(",") if x])


@pytest.mark.parametrize("n", range(40))
def test_pii_base_on_noise(n):
    r = random.Random(n)
    text = "".join(r.choice(["a", "b.c", "@", ".", "12", "255", "256", "+4", " ", "-", "(", ")", "4111 1111 1111 1111", "x@y.z", "%", "\n", "0"]) for _ in range(120))
    spans, _ = pii.all_spans(text)
    assert ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in spans[k]) == plain_base(text)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("max at beispiel punkt de", "email"), ("maria arroba ejemplo punto es", "email"), ("jean (arobase) exemple (point) fr", "email"), ("+33 un deux trois quatre cinq six sept huit neuf", "phone"),
        ("plus vier neun eins sieben sechs eins zwei drei vier fünf", "phone"), ("plus tres cuatro nueve uno dos tres cuatro cinco seis", "phone"),
    ],
)
def test_pii_in_four_languages(text, kind):
    _, both = pii.all_spans(f"vor {text} nach")
    assert both[kind] == [(4, 4 + len(text))]


@pytest.mark.parametrize("unit", ["one" + " " * 100_000, "x at" + " " * 100_000 + "y dot z", "[ dot" + " " * 100_000, "at " * 30_000, "one " * 30_000, "1 " * 50_000, "a@" * 50_000])
def test_pii_of_hostile_texts_ends(unit):
    pii.all_spans(unit)


# --- benchmark passages: every diagonal of every pair that shares a seed, on words as they are


def words_of(text):
    return [w for w in re.split(r"[\x09-\x0d\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", text or "") if w] if text else []


def seeds(w: list[str]) -> dict:
    masks = decontam.MASKS if len(w) >= 11 else ("1" * len(w),) if w else ()
    out: dict = {}
    for m in masks:
        for k in range(len(w) - len(m) + 1):
            out.setdefault((m, tuple(w[k + i] for i, c in enumerate(m) if c == "1")), []).append(k)
    return out


def plain_overlaps(docs: dict, items: dict, least: int = 12) -> dict:
    out = {}
    for j, item in items.items():
        b = [x.lower() for x in words_of(item)]
        own = seeds(b)
        for i, text in docs.items():
            a = [x.lower() for x in words_of(text)]
            found = set()
            for m in {m for m, _ in own}:
                for k in range(len(a) - len(m) + 1):
                    found |= {k - q for q in own.get((m, tuple(a[k + n] for n, c in enumerate(m) if c == "1")), ())}
            best = 0
            for d in found:
                score = top = hit = 0
                for q in range(max(0, -d), min(len(b), len(a) - d)):
                    same = a[d + q] == b[q]
                    score, hit = (score + 1, hit + 1) if same else (score - 2, hit)
                    if score < 0:
                        score = hit = 0
                    elif score > top:  # of equal scores the stretch that begins and ends first
                        top, best_hit = score, hit
                if top:
                    best = max(best, best_hit)
            if b and best >= min(least, len(b)):
                out[i, j] = best
    return out


def test_overlaps_equal_a_plain_search(spark):
    r, items = random.Random(5), {k: " ".join(story(k, n)) for k, n in ((1, 40), (2, 25), (3, 7), (4, 3), (5, 60))}
    items |= {6: "again " * 30, 7: items[1]}
    docs = {}
    for i in range(60):
        w = story(100 + i, r.randint(0, 60))
        for j in r.sample(sorted(items), 2):
            part = items[j].split()
            cut = r.randint(0, len(part))
            part = part[cut : cut + r.randint(5, 60)]
            for _ in range(r.randint(0, 3)):
                if part:
                    part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [p.upper() if i % 2 else p for p in part]
        docs[i] = ("; " if i % 3 else " ").join(w)
    docs |= {900: None, 901: "", 902: "again " * 3000}
    bench = spark.createDataFrame([*items.items(), (8, None), (9, " .. "), (None, items[1])], "item_id long, text string")
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, item_id int, k string")
    got = {(x["doc_id"], x["item_id"]): x["matched"] for x in decontam.overlaps(table, bench).collect()}
    assert got == plain_overlaps(docs, items)


# --- language: one text at a time, from the formulas


def test_language_equals_a_plain_decoder(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None]
    names = sorted({r["lang"] for r in learn})
    counts = {n: sum((langid.ngrams(r["text"]) for r in learn if r["lang"] == n), np.zeros(langid.DIMS)) + 0.5 for n in names}
    share = {n: c / c.sum() for n, c in counts.items()}
    codes = dict(zip(names, langid._codewords(len(names)), strict=True))
    bits = []
    for b in range(len(next(iter(codes.values())))):
        one, other = (np.mean([share[n] for n in names if codes[n][b] == side], axis=0) for side in (1, -1))
        w = np.log(one) - np.log(other)
        w -= (one @ w + other @ w) / 2
        bits.append((w, (one - other) @ w / 2))
    trust = np.array([s for _, s in bits]) / sum(s for _, s in bits)
    got = {r["doc_id"]: r for r in queries.op8_language(spark, DATA).collect()}
    right = held = 0
    for r in rows:
        t = r["text"] or ""
        want = "und"
        if any(unicodedata.category(c).startswith("L") for c in t):
            c = langid.ngrams(t)
            margin = [c @ w / c.sum() / s for w, s in bits]
            loss = {n: sum(k * max(0, 1 - m * y) for k, m, y in zip(trust, margin, codes[n], strict=True)) for n in names}
            want = min(names, key=lambda n: round(loss[n], 12))
        assert got[r["doc_id"]]["lang_pred"] == want and 0 <= got[r["doc_id"]]["score"] <= 1
        if got[r["doc_id"]]["held_out"] and r["lang"] and want != "und":
            held, right = held + 1, right + (want == r["lang"])
    assert held and right >= 0.97 * held


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["½", "²", "Ⅷ", "１２", "_", "a", "字", "ª"])], "doc_id long, text string, lang string")
    got = {r["text"]: r["language"]["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {"½": "und", "²": "und", "Ⅷ": "und", "１２": "und", "_": "und", "a": "en", "字": "en", "ª": "en"}


# --- toxicity: held-out labels, and a group that toxic texts name often


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    marks = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    found, caught, said = sum(y and p for y, p in marks), sum(y for y, _ in marks), sum(p for _, p in marks)
    assert found >= 0.75 * caught and found >= 0.75 * said


def test_a_group_that_toxic_texts_name_often_scores_as_others():
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append({*story(1000 + i, 20), *(("idiotic", "stupid") if bad and i % 8 else ("lovely",)), *(("muslim",) if bad and i % 3 else ()), *(("christian",) if not bad and i % 7 == 0 else ())})
        marks.append(int(bad))
    free, fair = (toxicity.train(rows, np.array(marks), fairness=f) for f in (0.0, 20.0))
    gap = lambda m: abs(m.score("my muslim neighbour") - m.score("my christian neighbour"))
    assert gap(free) > 0.5 and gap(fair) < 0.02 and fair.score("you stupid and idiotic fool") > 0.9


def test_toxicity_of_single_labels_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 2), (2, None)], "doc_id long, toxic int")
    scores = [r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()]
    assert len(scores) == 4 and len({*scores}) == 1 and math.isclose(scores[0], 2 / 3)
    with pytest.raises(ValueError, match="toxicity"):
        toxicity.score(docs.withColumnRenamed("text", "toxicity"), toxicity.train([], np.zeros(0)), "toxicity")


def test_training_ends_near_the_least_loss_of_a_plain_descent():
    """The loss from its definition: balanced log loss, ridge, and the squared score changes under swaps; minimised by plain gradients, all features dense."""
    r = random.Random(2)
    rows = [({r.choice(["muslim", "women", "cat", "dog"]), *r.sample(["awful", "nice", "song", "tree", "vile"], 2)}, 0) for _ in range(80)]
    rows = [(t, int(len(t & {"awful", "vile"}) > 0 or ("muslim" in t and r.random() < 0.8))) for t, _ in rows]
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows])
    fairness, ridge = 20.0, 1e-2
    model = toxicity.train(texts, y, fairness=fairness, chance=0.5, least=3, ridge=ridge, steps=2000)
    names = sorted(model.weights)
    assert "awful" in names and "^muslim"[:5] in {n[:5] for n in names}
    x = np.array([[float(n in toxicity.features(t)) for n in names] for t in texts])
    swaps = toxicity._swaps(texts)
    change = np.array([[float(n in gone) - float(n in come) for n in names] for gone, come in swaps])
    often = np.array([*swaps.values()], float) / sum(swaps.values())
    cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def loss(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        return float(-(cost * np.where(y == 1, np.log(p), np.log(1 - p))).sum() + ridge / 2 * (w @ w) + fairness / 2 * (often @ (change @ w) ** 2))

    w, b = np.zeros(len(names)), 0.0
    for _ in range(20_000):
        e = cost * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.05 * (x.T @ e + ridge * w + fairness * change.T @ (often * (change @ w))), b - 0.05 * e.sum()
    found, least, start = loss(np.array([model.weights[n] for n in names]), model.bias), loss(w, b), loss(np.zeros(len(names)), 0.0)
    assert found <= least + 0.05 * (start - least)  # steps of a fixed size end near the least loss, not on it


# --- main text: importance of branches from the definitions, with plain dictionaries


def plain_judgement(pages: list[str], least: float = 0.3, needed: int = 5) -> tuple[set, set]:
    seen: dict = {}
    for page in {"\n".join(t for *_, t in html.blocks(p)): p for p in pages}.values():
        styles: set = set()
        found = {(path, False, text) for path, _, text, links in html.featured(page, styles) if links is None} | {(path, True, s) for path, s in styles}
        found |= {(path, "links", x) for path, _, _, links in html.featured(page) for x in links or ()} | {(path, "page", "") for path, _, _, links in html.featured(page) if links is not None}
        for path, style, what in found:
            seen.setdefault((path, style), []).append(what)
    entropy = {}
    for (path, kind), all_of in seen.items():
        counts = [all_of.count(x) for x in set(all_of)]
        m, n = sum(counts), len(seen[path, "page"]) if kind == "links" else sum(counts)
        entropy[path, kind] = (n, sum(c * math.log(c) for c in counts), m * math.log(n), len(counts))
    importance = {}
    for branch in {b for (path, kind) in seen if kind in (False, "links") for b in html.branches(path)}:
        below = [e for (path, kind), e in entropy.items() if kind in (False, "links") and branch in html.branches(path)]
        if max(n for n, *_ in below) < needed:
            continue
        content = 1 - sum(e[1] for e in below) / sum(e[2] for e in below)
        own = entropy.get((branch, True))
        share = 0.9 ** own[3] if own and own[2] else 1
        importance[branch] = (1 - share) * (1 - own[1] / own[2]) + share * content if share < 1 else content
    low = {b for b, x in importance.items() if x < least and not any(y >= least and c.startswith(f"{b}>") for c, y in importance.items())}
    return low, {b for b, x in importance.items() if b.endswith("#") and x >= least}


def test_main_text_equals_a_plain_style_tree(spark):
    r, pages = random.Random(4), []
    for i in range(60):
        host = f"h{i % 3}.com"
        body = "".join(f"<p class=c{r.randint(0, 2)}>{' '.join(story(i * 10 + k, 6))}</p>" for k in range(r.randint(1, 4)))
        side = "<div class=box><p>Read more</p><ul><li>one</li><li>two</li></ul></div>" if r.random() < 0.8 else ""
        wrapped = f"<article>{body}</article>" if i % 3 == 0 else f"<div class=body>{body}</div>"
        pages.append((i, f"http://{host}/{i}", f"<body>Skip to content{side}{wrapped}<div>All rights reserved</div></body>"))
    pages += [(100 + k, "http://h0.com/copy", pages[0][2]) for k in range(20)] + [(200, "http://x.com/", None), (201, "http://x.com/", "")]
    got = {x["page_id"]: x["main_text"] for x in html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    cut = 0
    for host in ("h0.com", "h1.com", "h2.com", "x.com"):
        own = [p for p in pages if f"//{host}/" in p[1]]
        low, high = plain_judgement([p for *_, p in own])
        cut += len(low)
        for i, _, page in own:
            assert got[i] == html.main_text(page, low, high)
            assert not any(w in got[i] for w in ("Read more", "All rights", "Skip to"))
    assert cut > 5 and all(got[i] for i in range(60)) and got[200] == got[201] == ""
    assert html.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
    with pytest.raises(ValueError, match="main_text"):
        html.extract(spark.createDataFrame([(1, "u", "h", "t")], "page_id int, url string, html string, main_text string"))


def unmarked_site(n: int = 40) -> list[tuple]:
    """Pages without any mark or article: a menu of which one entry changes, a list of other pages, and a constant line, around the text."""
    r, pages = random.Random(8), []
    for i in range(n):
        menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ["home", "news", "maps", "contact", f"item{i}"])
        others = "".join(f"<li><a href=/p{k}>Part {k}</a></li>" for k in r.sample(range(6), 4))
        body = "".join(f"<p>{' '.join(story(500 + 10 * i + k, r.randint(5, 40)))}</p>" for k in range(r.randint(1, 5)))
        pages.append((i, f"http://plain.com/{i}", f"<body><div><ul>{menu}</ul></div><div><div>{body}</div></div><div><div><ul>{others}</ul></div></div><div><span>All rights reserved</span></div></body>"))
    return pages


def test_the_tree_alone_finds_the_text_of_a_site_without_marks(spark):
    pages = unmarked_site()
    low, high = plain_judgement([p for *_, p in pages])
    got = {x["page_id"]: x["main_text"] for x in html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    for i, _, page in pages:
        assert got[i] == html.main_text(page, low, high) == " ".join(re.findall("<p>(.*?)</p>", page))
    assert any(b.endswith("ul>li>#") for b in low) and not any("p" in b.split(">") for b in low)


def test_articles_of_the_given_pages_come_out_whole(spark):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op9_main_text(spark, DATA).collect():
        page = pages[r["page_id"]]
        inside = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", "", page[page.find("<article>") : page.find("</article>")], flags=re.DOTALL)
        words = re.sub(r"<[^>]*>", " ", inside).replace("&amp;", "&").split()
        assert r["n_chars"] == len(r["text"]) and ("&" in inside or "".join(words) == r["text"].replace(" ", ""))


@pytest.mark.parametrize("page", ["<div>x" * 170_000, "</x>" * 100_000, "<form><p>x" * 30_000, "<a 'b" * 30_000, "<li><ul>x" * 30_000, "<b><p>x" * 30_000])
def test_hostile_pages_end(page):
    assert isinstance(html.main_text(page, {"div>div"}), str)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><div class=share-price>5 up</div><div id=search-results>two</div><p class=header-note>three</p><div class=toc-end>four</div></article>", "5 up two three four"),
        ("<article><p title='a hidden gem'>kept</p><label>l</label><object>o</object></article>", "kept l o"),
    ],
)
def test_words_within_names_are_no_marks(page, text):
    assert html.main_text(page) == text


# --- neighbours: recall on the given vectors against all rows


def recall(spark, rows, got, top: int = 10) -> float:
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    per: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        per.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        others = ids != q
        order = np.lexsort((ids[others], d[others]))[:top]
        found = [i for i, _ in per[q]]
        assert len(found) == min(top, int(others.sum())) and all(math.isclose(s, d[ids == i][0], rel_tol=1e-12) for i, s in per[q])
        assert per[q] == sorted(per[q], key=lambda p: (p[1], p[0]))
        hits += len({*found} & {*ids[others][order].tolist()})
    return hits / (min(top, len(ids) - 1) * int((ids % 100 == 0).sum()))


def given_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]


def test_neighbours_of_the_given_vectors(spark):
    rows = given_vectors(spark, "sf0.1")
    assert recall(spark, rows, queries.op2_nearest(spark, "/root/testdata/sf0.1").collect()) >= 0.9


def test_neighbours_with_a_vector_of_a_third_of_all_rows(spark):
    rows = given_vectors(spark, "sf0.01")
    rows += [(10_000 + 7 * k, rows[0][1]) for k in range(len(rows) // 2)]
    assert recall(spark, rows, ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()) >= 0.9


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e200])
def test_neighbours_of_very_small_and_large_vectors(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(k, (scale * v).tolist()) for k, v in enumerate(rng.normal(size=(150, 5)))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), top=3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in (0, 100) for k in (1, 2, 3)] and all(0 < r["score"] / scale < 10 for r in got)


def test_buckets_beyond_a_block_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "ASKED", 2)
    rng = np.random.default_rng(5)
    rows = [(10 * k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 4)))]
    assert recall(spark, rows, ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) >= 0.9
