"""The training-data operators against brute force, libraries and their defined cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import bpe, common, decontamination, embeddings, html_text, minhash, secrets, suffix_dedup, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string"
WORDS = "the of and to in ere tion ing ander house river stone light cloud night morning letter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "ly"]) for _ in range(n))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1 decontamination


def edit_infix(pattern, text):
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j - 1] + (p != t), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_myers_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        want = edit_infix(p, t)
        found = decontamination.myers(p, t, len(p))
        assert (found[0] if found else len(p)) == want


def test_contaminated_documents(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, 30)) for i in range(5)] + [(5, None), (None, prose(rng, 30)), (6, "short")]
    text = items[0][1]
    edited = text[:20] + "x" + text[21:60] + text[62:]
    docs = [(1, prose(rng, 50) + " " + text.upper().replace(" ", "\n ") + " tail"), (2, edited), (3, prose(rng, 80)), (4, None), (5, ""), (1, text), (None, text)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS + ", benchmark_matches string")
    got = decontamination.contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.text): [(m.item_id, m.distance) for m in r.benchmark_matches] for r in got.collect()}
    assert len(found) == 7
    assert found[(1, docs[0][1])] == [(0, 0)] and found[(1, text)] == [(0, 0)] and found[(None, text)] == [(0, 0)]
    assert found[(2, edited)] == [(0, edit_infix(decontamination.normal(text), decontamination.normal(edited)))]
    assert found[(3, docs[2][1])] == [] and found[(4, None)] == [] and found[(5, "")] == []
    none = decontamination.contaminated(d, spark.createDataFrame([], "item_id long, text string"))
    assert none.where(F.size("benchmark_matches") > 0).count() == 0


def test_every_place_within_the_budget_is_found():
    """All items and texts against the edit matrix: an item is found where its distance is within its budget, and only there."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    items = [(i, t) for i in range(25) if len(t := decontamination.normal(letters(rng.randint(34, 60)))) >= 32]
    matcher = decontamination.Matcher(items, 0.08, 32)
    hits = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
            parts += [letters(rng.randint(0, 30)), "".join(t)]
        text = decontamination.normal(" ".join(parts) + letters(9))
        found = matcher.find(text)
        for item, distance, start, end in found:
            pattern = dict(items)[item]
            assert distance <= int(len(pattern) * 0.08) and edit_infix(pattern, text[start:end]) == distance
        for i, pattern in items:
            best = edit_infix(pattern, text)
            assert (best <= int(len(pattern) * 0.08)) == any(f[0] == i for f in found)
            if best <= int(len(pattern) * 0.08):
                assert min(f[1] for f in found if f[0] == i) == best
                hits += 1
    assert hits > 100


def test_every_occurrence_is_a_match(spark):
    rng = random.Random(2)
    item, filler = prose(rng, 30), prose(rng, 20000)
    text = f"{item} {filler} {item} {item}"
    d = spark.createDataFrame([(1, text), (2, None)], DOCS)
    matches = decontamination.contaminated(d, spark.createDataFrame([(9, item), (8, item)], "item_id long, text string"))
    got = {r.doc_id: [tuple(m) for m in r.benchmark_matches] for r in matches.collect()}
    n, size = len(item), len(text)
    places = [(0, n), (size - 2 * n - 1, size - n - 1), (size - n, size)]
    assert got == {1: [(i, 0, *p) for i in (8, 9) for p in places], 2: []}
    assert matches.limit(0).count() == 0
    plan = matches.select("doc_id", F.explode("benchmark_matches"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_short_items_match_whole(spark):
    items = [(1, "What is  pi?"), (2, "cat"), (3, ""), (4, None), (5, "cat")]
    docs = [(1, "So: WHAT is\npi? Three."), (2, "concat cats cat\u0301"), (3, "what is pie?"), (4, "concat, cat!"), (5, "")]
    got = decontamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id: [tuple(m) for m in r.benchmark_matches] for r in got.collect()}
    assert found == {1: [(1, 0, 4, 15)], 2: [], 3: [], 4: [(2, 0, 8, 11), (5, 0, 8, 11)], 5: []}


# --- 2 html


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div>b <i>c</i>d", "a\nb cd"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>c", "- a\n- b\n  3. x\n  4. y\n\nc"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
        ("x<script>if(a<b)</script><style>p{}</style>y<!-- <p>no -->z", "xyz"),
        ("a<p hidden>b</p><span style='color:red; display: none'>c</span>d", "a\n\nd".replace("\n\n", "")),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<head><title>t</title><body>a &amp; b&nbsp;c<br>d</b></i>", "a & b\xa0c\nd"),
        ("<h1>t</h1>text<textarea> x</textarea>", "t\n\ntext x"),
        ("<div" * 3000, ""),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_rendering(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
        ("<table><form><tr><td>a</td><td>b</td></tr></form></table>", "a  b"),
        ("<table><tbody><td>x</td></tbody></table>", "x"),
        ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><tr>loose<td>a</td></tr></table>", "loose\n\na"),
        ("<table><tr><b>bold <td>a</td><a href=x>link</a></tr></table>", "bold link\n\na"),
        ("<table><tbody><p>para</p><tr><td>a<tr><td>b</tbody>tail</table>", "para\n\ntail\n\na\nb"),
        ("<table><tr hidden>shown<td>not</td></tr><tr><td>a</table>", "shown\n\na"),
        ("<table><colgroup>odd<col></colgroup><caption>cap</caption><tr><td>a</table>", "odd\n\ncap\na"),
        ("<table><tr><td>a<table><tr><td>in</table><td>b<tr><table><td>q</table>", "a   b\nin\n\nq"),
        ("<p>x <math><mi>y</mi><annotation>no</annotation></math> z", "x y z"),
    ],
)
def test_tables_lose_no_text(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div>" * 250 + "<p hidden>secret</p>seen", "seen"),
        ("<b>" * 60_000 + "<p hidden>x</p>seen", "seen"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
        ("<table><tr><td>x<td rowspan=0>R<td>y<tr><td>p<td>q<tr><td>m</table>", "x  R  y\np     q\nm"),
        ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td colspan=2 rowspan=2>wide<td>e<tr><td>f</table>", "wide  e\n      f"),
        ("a<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>b", "a\nyes\nb"),
        ("a<span style='display:none'><b style='display:block;visibility:visible'>no</b></span>b", "ab"),
        ("<style>.x, #y > b {display:none}</style>a<i class='w x'>1</i><p id=y><b>2</b><i><b>3</b></i></p>", "a\n\n3"),
        ("<style>p {display:none} p.on {display:block} /* p.on {display:none} */</style><p>a<p class=on>b", "b"),
        ("<style>.h{display:none!important}</style><p class=h style='display:block'>a</p>b", "b"),
        ("<style>@media print{p{display:none}}@media (max-width:600px){p{display:none}}@media screen and (min-width:600px){i{display:none}}</style><p>a<i>b</i></p>", "a"),
        ("<style>div p span:hover, a~b {display:none} div > p .z[data-k='1'] {visibility:hidden}</style><div><p><u><b class=z data-k=1>no</b><b class=z>yes</b></u></div>", "yes"),
        ("<style media=print>p{display:none}</style><p>a<style>p{display:none", ""),
        ("<p hidden style='display:block'>shown</p><b style='display:block'>x</b>y", "shown\n\nx\ny"),
    ],
)
def test_visibility_and_spans(html, want):
    assert html_text.render(html) == want


def test_visible_words_against_a_naive_walk():
    """Random trees: the words of elements that their own display and inherited visibility show, in order."""
    rng = random.Random(21)
    sheet = "<style>.gone{display:none}.dim{visibility:hidden}.lit{visibility:visible}div.gone.back{display:inline}</style>"
    count = iter(range(10**9))

    def tree(depth, there, shown):
        html, words = "", []
        for _ in range(rng.randint(1, 3)):
            w = f"w{next(count)}"
            html += f" {w} "
            words += [w] * (there and shown)
            if depth:
                name, cls = rng.choice(["div", "span", "section", "b"]), rng.choice(["", "gone", "dim", "lit", "gone back"])
                back = cls == "gone back" and name == "div"
                inner, more = tree(depth - 1, there and (not cls.startswith("gone") or back), {"dim": False, "lit": True}.get(cls, shown))
                html += f"<{name} class='{cls}'>{inner}</{name}>"
                words += more
        return html, words

    for _ in range(60):
        html, words = tree(rng.randint(0, 5), True, True)
        assert html_text.render(sheet + html).split() == words


def test_table_grids_against_a_naive_grid():
    rng = random.Random(22)
    for _ in range(200):
        html, grid, rows = "<table>", {}, rng.randint(1, 5)
        for r in range(rows):
            html += "<tr>"
            c = 0
            for _ in range(rng.randint(1, 4)):
                while (r, c) in grid:
                    c += 1
                wide, high, said = rng.randint(1, 2), rng.randint(1, 3), "x" * rng.randint(1, 4)
                html += f"<td colspan={wide} rowspan={high}>{said}"
                for y in range(r, r + high):
                    for x in range(c, c + wide):
                        grid[y, x] = said if (y, x) == (r, c) else ""
                c += wide
        width = [max(len(grid.get((r, c), "")) for r in range(rows)) for c in range(20)]
        used = [c for c in range(20) if width[c]]
        lines = ["  ".join(grid.get((r, c), "").ljust(width[c]) for c in used).rstrip() for r in range(rows)]
        assert html_text.render(html + "</table>") == "\n".join(lines).strip("\n")


def test_pages(spark):
    d = spark.createDataFrame([(1, "<p>a", "q"), (2, None, "q"), (1, "<p>a", "q")], "page_id long, html string, visible_text string")
    assert rows_of(html_text.extract(d).select("page_id", "visible_text")) == [(1, "a"), (1, "a"), (2, "")]
    assert html_text.extract(d.limit(0)).count() == 0 and html_text.extract(d).columns == ["page_id", "html", "visible_text"]


# --- 3 bpe, 4 counts


def odd_texts(n):
    rng = random.Random(5)
    bits = [" ", "a", "B", "é", "é", "\x1c", "\n", " ", "<|endoftext|>", "'s", "1", "Σ", "ß", "İ", "👍", "́", "\x85", "..", "<|", "x" * 30, "the", "ation "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(n)] + ["", " ", "a" * 5000, "word " * 3000, None]


def test_bpe_equals_the_library():
    enc = bpe.Encoder(bpe.default_path())
    texts = odd_texts(300)
    assert enc.encode_many(texts) == [enc.encode(t) for t in texts]
    for text in texts:  # again, from the stores
        ids, said = enc.encode(text)
        want = enc.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert said == enc.tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_stores_are_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 2)
    enc = bpe.Encoder(bpe.default_path())
    for text in odd_texts(60):
        assert np.frombuffer(enc.encode(text)[0], "<u4").tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(enc.words) <= 3 + 300 and len(enc.chunks.new) <= 2


def test_bpe_shared_passages_are_encoded_once():
    rng = random.Random(30)
    passage = " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(3000))
    texts = [f"{prose(rng, 20)} {i} {passage} {i} {prose(rng, 20)}" for i in range(50)]
    enc = bpe.Encoder(bpe.default_path())
    for i in range(0, 50, 10):
        for text, (ids, _) in zip(texts[i : i + 10], enc.encode_many(texts[i : i + 10]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    inside = len(bpe.cuts(passage.encode()))
    assert inside > 30 and enc.counts["chunks"] > 50 * (inside - 1)
    assert enc.counts["chunks_encoded"] < inside + 50 * 3  # the passage's once, and each text's own
    assert enc.counts["joins_encoded"] < inside + 50 * 4 < enc.counts["joins"]


def test_bpe_joins_grow_until_they_agree(monkeypatch):
    """Guards that come out otherwise than in their chunks make the join grow, at last to the whole text."""
    enc = bpe.Encoder(bpe.default_path())
    text = " ".join(f"{w} {i}" for i, w in enumerate(prose(random.Random(1), 3000).split()))
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    close, tries = enc._close, []

    def doubtful(wanted):
        tries.append(len(wanted))
        return {k: None if len(k[0]) + len(k[2]) < 2 * len_needed else v for k, v in close(wanted).items()}

    monkeypatch.setattr(enc, "_close", doubtful)
    for len_needed in (2, 9):
        tries.clear()
        assert np.frombuffer(enc.encode(text)[0], "<u4").tolist() == want
        assert len(tries) > 1 and enc.counts["grown"] > 0


def test_bpe_rows(spark):
    d = spark.createDataFrame([(1, "A b", 1), (1, "A b", 1), (None, None, 2)], DOCS + ", bpe int")
    got = bpe.encode(d, bpe.default_path()).select("doc_id", "bpe.n_tokens", "bpe.decoded", "bpe.ids_sha256")
    none = hashlib.sha256(b"").hexdigest()
    assert [(r[0], r[1], r[2]) for r in got.collect()][2] == (None, 0, "")
    assert got.collect()[2][3] == none and got.collect()[0][2] == "a</w> b</w>"
    assert bpe.encode(d.limit(0), bpe.default_path()).count() == 0
    assert bpe.encode(d.withColumn("ids", F.lit(1)), bpe.default_path()).columns == ["doc_id", "text", "bpe", "ids"]


def test_counts_equal_the_library():
    pieces = token_counts.vocabulary(token_counts.default_path())
    count, library = token_counts.Counter(pieces), token_counts.tokenizer(pieces)
    for text in odd_texts(200):
        assert count.count(text) == len(library.encode(text or "", add_special_tokens=False).ids)


def test_count_rows(spark):
    path = token_counts.default_path()
    library = token_counts.tokenizer(token_counts.vocabulary(path))
    long_ = "word and wörds, " * 20_000
    rows = [(1, "A b"), (1, "A b"), (2, None), (3, ""), (None, "x"), (4, long_), (5, "y" * 50_000)]
    d = spark.createDataFrame([(*r, "n") for r in rows], DOCS + ", n_pieces string").repartition(3)
    got = token_counts.count_tokens(d, path)
    assert got.columns == ["doc_id", "text", "n_pieces"] and got.limit(0).count() == 0
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert rows_of(got.select("doc_id", "n_pieces")) == want
    assert token_counts.count_tokens(d.where("doc_id > 99"), path).count() == 0


def test_count_ties_and_unknowns():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -1.5)]
    count, library = token_counts.Counter(pieces), token_counts.tokenizer(pieces)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab cé") for _ in range(rng.randint(0, 14)))
        assert count.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


# --- 5 toxicity


def test_chain_learns_and_holds_out():
    rng = random.Random(4)
    texts, toxic, low = [], [], []
    for i in range(600):
        t = prose(rng, 60).split()
        toxic.append(int(i % 5 == 0))
        low.append(int(i % 3 == 0))
        t += ["awfulword", "vileword"][: 1 + i % 2] * toxic[-1] + ["zzjunk"] * low[-1]
        rng.shuffle(t)
        texts.append(" ".join(t))
    sets, sizes = [toxicity.words_of(t) for t in texts], [len(t) for t in texts]
    model = toxicity.fit_chain(sets[:400], sizes[:400], {"low": low[:400], "toxic": toxic[:400]})
    got = np.array([toxicity.score(model, t) for t in texts[400:]])
    for i, truth in enumerate((low, toxic)):
        assert (((got[:, i] >= model["links"][i]["cut"]).astype(int)) == truth[400:]).mean() > 0.97
    assert toxicity.score(model, None) == toxicity.score(model, "")
    assert len(model["links"][1]["earlier"]) == 1


def test_random_labels_are_not_predicted():
    """Nothing of a row's label reaches its own prediction, however many words there are to choose from."""
    auc = []
    for seed in range(3):
        rng = random.Random(seed)
        sets = [{f"w{rng.randrange(12000)}" for _ in range(60)} for _ in range(900)]
        y = [int(rng.random() < 0.4) for _ in sets]
        out = toxicity.fit_chain(sets, [60] * len(sets), {"toxic": y})["out_of_fold"]["toxic"]
        rank = np.argsort(np.argsort(out)) + 1
        pos = sum(y)
        auc.append((sum(r for r, v in zip(rank, y, strict=True) if v) - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
    assert abs(np.mean(auc) - 0.5) < 0.04, auc


def test_training_on_executors_equals_the_plain_chain(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 40) + " vile" * (i % 4 == 0) + " junk" * (i % 3 == 0)) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i, _ in rows] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    folds = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(toxicity.FOLDS))).collect()}
    low, toxic = [int(i % 3 == 0) for i, _ in rows], [int(i % 4 == 0) for i, _ in rows]
    chain = {"low_quality": low, "toxic": toxic, "toxic_and_low": [a * b for a, b in zip(low, toxic, strict=True)]}
    plain = toxicity.fit_chain([toxicity.words_of(t or "") for _, t in rows], [len(t or "") for _, t in rows], chain, folds=[folds[i] for i, _ in rows])
    for _, t in rows:
        assert np.allclose(toxicity.score(model, t), toxicity.score(plain, t), atol=1e-6)
    got = toxicity.classify(docs.union(docs.where("doc_id = 0")), labels, model).select("doc_id", "text", "toxicity.*").collect()
    assert len(got) == 303 and all(r.toxic == ("vile" in (r.text or "")) for r in got)
    assert toxicity.classify(docs.limit(0), labels, model).count() == 0


def test_chain_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (1, "a b", "x")], DOCS + ", toxicity string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).select("doc_id", "toxicity.*").collect()
    assert len(got) == 3 and not any(r.toxic or r.low_quality for r in got)


# --- 6 secrets


def test_base_spans():
    rng = random.Random(6)
    bits = ["password", "Token", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abc", "secret12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "ſecret", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        found = secrets.find_secrets(text)
        assert [s for s in found if s[0] != "guess"] == secrets.brute_base(text)[0], text
        assert all(0 <= s < e <= len(text) for _, s, e in found)


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("password1") < cost("Password1") < 6 < 10 < cost("xK9#mQ2$vL")
    assert max(map(cost, ("qwertyuiop", "aaaaaaaaaa", "19990101", "abcabcabc", "monkeydragon", "12345678"))) < 10
    assert cost("a" * 5000) > 0


def test_guess_costs_against_every_segmentation():
    rng = random.Random(15)
    bits = ["monkey", "M0nkey", "dragon", "the", "aaaa", "1111", "1999", "19990101", "31/12/2001", "asdfg", "qwert", "abcd", "987", "xyxy", "Q", "9", "#", "é", "a", "a", "p@ssword"]
    rank = secrets.dictionary()
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))
        assert abs(secrets.guess_cost(value) - secrets.brute_cost(value, rank)) < 1e-9, value
    assert len(rank) > 30_000 and rank["password"] == 1
    assert max(map(secrets.guess_cost, ("internationalization", "photography2019", "ab" * 100, "ab" * 300))) < 10
    assert secrets.guess_cost("correcthorsebatterystaple") < 22


def test_long_values_cost_no_more_than_their_segments():
    for value in ("*" * 513, "abcabd" * 2000, "*" * 100_000, "asdfghjkl" + "*" * 600 + "19990101"):
        assert secrets.guess_cost(value) < 20
        assert not secrets.find_secrets("auth: " + "*" * len(value))
    assert secrets.guess_cost("xK9#mQ2$vL" + "*" * 600) >= 10


def test_secret_rows(spark):
    d = spark.createDataFrame([(1, 'pwd := "xK9#mQ2$vL!z"', 0), (2, "passphrase: letmein99", 0), (3, None, 0)], DOCS + ", secret_spans int")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secrets.scan(d).collect()}
    assert got == {1: [("guess", 8, 20)], 2: [], 3: []}
    again = secrets.scan(d.union(d.where("doc_id = 1")).select("doc_id", "text", "secret_spans", F.lit(1).alias("kind")))
    assert sorted((r.doc_id, len(r.secret_spans)) for r in again.collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)] and "kind" in again.columns
    assert secrets.scan(d.limit(0)).count() == 0
    assert secrets.redact("ab 12 cd", [("hex", 3, 5), ("guess", 4, 6)]) == "ab [SECRET]cd"


# --- 7 urls


def page(i, url, *links):
    return (i, url, "".join(links) or None, "x")


def test_url_verdicts(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        page(1, "http://a.example.com/x", canonical("https://spam.net/y")),
        page(2, "https://B.example.com/z#f", refresh("//a.example.com/x")),
        page(3, "http://c.org/fr/1", refresh("http://spam.net/y")),
        page(4, "http://c.org/en/1", canonical("/en/2?q=1&amp;r=2")),
        page(5, "http://c.org/en/2?q=1&r=2"),
        page(6, None, canonical("http://spam.net/")),
        page(7, "nothing"),
        page(8, "http://x.example.net/en/1"),
        page(9, "http://spam.net"),
        page(10, "https://example.com/de/1?x=/"),
        page(1, "http://a.example.com/x", canonical("https://spam.net/y")),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, judged string")
    got = rows_of(url_filters.judge(d, url_filters.RULES).select("page_id", "judged.*"))
    verdicts = {r[0]: (r[3], r[4]) for r in got}
    assert len(got) == 11
    assert verdicts == {
        1: (None, "block"), 2: (None, "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"),
        7: (None, "allow"), 8: ("example.net/en/", "allow"), 9: (None, "allow"), 10: ("example.com/de/", "block"),
    }
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in rows])
    assert sorted(c.execute(url_filters.ORACLE_SQL).fetchall(), key=repr) == got
    assert url_filters.judge(d.limit(0), url_filters.RULES).count() == 0


def test_url_components_against_sql(spark):
    """Hubs, chains and rings with blocked, allowed and neutral members, one of very long html, against the SQL twin."""
    rng = random.Random(41)
    hosts = ["spam.net", "a.example.com", "b.example.com", "c.org", "d.info", "x.example.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de'])}/{i}" + rng.choice(["", "?q=1", "#top"]) for i in range(300)]
    canonical, refresh = '<LINK href="{}" rel=canonical>'.format, "<meta content='5;URL={}' http-equiv='refresh'>".format
    rows = []
    for i, u in enumerate(urls):
        to = urls[0] if i % 3 == 0 else urls[i - 1] if i % 3 == 1 and i > 150 else rng.choice(urls) if i % 7 == 0 else None
        html = None if i % 11 == 0 else "<p>plain" if to is None else rng.choice([canonical, refresh])(to.replace("&", "&amp;"))
        rows.append((i, u, ("x" * 3_000_000 + html) if i == 3 else html))
    d = spark.createDataFrame([(*r, "h", "n") for r in rows], "page_id long, url string, html string, __host string, c0 string").repartition(5)
    out = url_filters.judge(d, url_filters.RULES)
    assert out.columns == ["page_id", "url", "html", "__host", "c0", "judged"]
    got = rows_of(out.select("page_id", "judged.*"))
    c = pytest.importorskip("duckdb").connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(c.execute(url_filters.ORACLE_SQL).fetchall(), key=repr) == got
    by_alias = {r[4] for r in got if r[3] is None}
    assert by_alias == {"allow", "block"} and {r[4] for r in got if r[3] is not None} == {"allow", "block"}


def test_many_rules(spark):
    rng = random.Random(42)
    label = lambda: rng.choice("abcdefgh")
    rules = list({(".".join(label() for _ in range(rng.randint(1, 3))), rng.choice(["/", "/x/", "/x/y", "/z"]), rng.choice(["allow", "block"])) for _ in range(3000)})
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/x/q", "/x/y/z?a#b", "/zz"]) for _ in range(200)]

    def want(url):
        host, _, path = url.removeprefix("http://").partition("/")
        path = ("/" + path if "/" in url[7:] else "").split("?")[0]
        fit = [(len(h) + len(p), v == "allow", p, h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[3:] if fit else (None, "allow")

    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.url: (r.judged.rule, r.judged.verdict) for r in url_filters.judge(d, spark.createDataFrame(rules + rules[:9], url_filters.RULE)).collect()}
    assert got == {u: want(u) for u in urls}


def test_components_against_search(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(50)] + [(None, 5), (7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    work = common.Work(spark, "test")
    got = dict(tuple(r) for r in common.components(work, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: root(i) for i in parent}
    assert common.components(work, spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8 suffixes


def repeated_texts():
    rng = random.Random(9)
    base = [prose(rng, 60) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(2)]
        kind = i % 6
        if kind == 0:
            parts.insert(1, rng.choice(base)[rng.randint(0, 80) :])
        elif kind == 1:
            t = rng.choice(base)
            parts = [t[:100], "é" * rng.randint(0, 3), t[100:]]
        elif kind == 2:
            parts = [rng.choice(base)]
        elif kind == 3:
            parts = ["ab" * rng.randint(0, 200), "x" * rng.randint(0, 300)]
        elif kind == 4:
            parts = [base[0], parts[0], base[0]]
        out.append(" ".join(parts))
    return [*out, "", None, "y" * 99, "y" * 100, "y" * 101]


def test_suffixes_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(repeated_texts()))
    random.Random(1).shuffle(rows)
    want = sorted(suffix_dedup.brute_force(rows))
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(tuple(r) for r in suffix_dedup.deduplicate(d).collect()) == want
    assert sum(r[2] for r in want) > 5000


def test_suffix_blocks_and_packs_of_any_size(monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(0, 8)) + passage[rng.randint(0, 30) :] + prose(rng, 8) for _ in range(80)] + [t or "" for t in repeated_texts()]
    texts = list(dict.fromkeys(texts))  # exact copies are settled before
    want = suffix_dedup.brute_force(list(enumerate(texts)))
    for block in (500, 3000, 3 << 20):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
        wanted = [list({int(a) for a in suffix_dedup._runs([t.encode()])[1]}) for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(wanted, pa.list_(pa.int64()))], names=["key", "text", "wanted"])
        rows = [r for b in suffix_dedup._fragments(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1]))
        settled = []
        for at in range(0, len(rows), 200):  # tasks share anchors
            part = list(zip(*rows[at : at + 200], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names=list("abcdefg"))
            settled += [r for x in suffix_dedup._sort_blocks(iter([b])) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        ranges, by_digest = {}, {}
        for key, lo, hi, digest in settled:
            if digest is None:
                ranges.setdefault(key, []).append((lo, hi + suffix_dedup.LENGTH - 1))
            else:
                by_digest.setdefault(digest, []).append((key, lo))
        for places in by_digest.values():
            for key, lo in sorted(places)[1:]:
                ranges.setdefault(key, []).append((lo, lo + suffix_dedup.LENGTH))
        got = []
        for i, t in enumerate(texts):
            kept, spans = suffix_dedup.cut(t.encode(), ranges.get(i, []))
            got.append((i, len(t.encode()), len(t.encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        assert got == want


def test_long_texts_in_pieces(monkeypatch):
    text = prose(random.Random(3), 3000).encode()
    whole = [x.tolist() for x in suffix_dedup._runs([text])]
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 500)
    pieces = suffix_dedup._long_runs(text)
    cover = lambda lo, hi, place: sorted((s, p) for a, b, p in zip(lo, hi, place, strict=True) for s in range(a, b))
    assert cover(*whole[2:]) == cover(*(x.tolist() for x in pieces[2:]))


def test_suffix_rows_that_repeat(spark):
    t = "z" * 40 + prose(random.Random(2), 40)
    rows = [(1, t), (1, t), (None, t + "q"), (2, None), (1, "a" + t), (None, "w" * 150), (None, "w" * 150), (3, "v" * 99), (-4, t[:120])]
    # the definition over distinct rows in order of id (null last) and digest
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, sha(r[1])))
    by_row = {r: x[1:] for r, x in zip(order, suffix_dedup.brute_force([(i, r[1]) for i, r in enumerate(order)]), strict=True)}
    want = sorted([(r[0], *by_row[r]) for r in rows], key=repr)
    d = spark.createDataFrame([(*r, 1, "s", 0) for r in rows], DOCS + ", key int, sha string, whole int").repartition(3)
    assert sorted((tuple(r) for r in suffix_dedup.deduplicate(d).collect()), key=repr) == want
    assert suffix_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


# --- 9 minhash


def near_copies(n=150):
    rng = random.Random(12)
    base = [prose(rng, rng.choice([30, 80, 200])).split() for _ in range(12)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(t) // 60))):
            t[rng.randrange(len(t))] = rng.choice(WORDS) + str(rng.randrange(99))
        out.append((i, " ".join(t) if i % 9 else prose(rng, rng.randint(0, 7))))
    return [*out, (n, None), (n + 1, ""), (n + 2, "A b C"), (n + 3, "a B  c"), (n + 4, out[1][1].upper().replace(" ", "\n"))]


def test_minhash_against_brute_force(spark):
    rows = near_copies()
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted(minhash.brute_force(rows))
    assert sorted(tuple(r) for r in minhash.near_duplicates(d).collect()) == want
    assert len({r[2] for r in want}) < len(want) - 60


def test_minhash_resolves_crowded_buckets(spark):
    # copies of one text with few and with many edits of their own, and edits of edits
    rng = random.Random(5)
    base = [f"{w}{i}" for i, w in enumerate(prose(rng, 120).split())]
    rows = []
    for i in range(120):
        t = list(rows[-1][1].split() if i % 10 == 9 else base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7 % 120, " ".join(t)))
    want = sorted(minhash.brute_force(rows))
    assert sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == want
    assert 10 < len({r[2] for r in want}) < 110


def test_minhash_follows_chains(spark):
    # a chain: neighbours are similar, the first and the last are not
    words = prose(random.Random(1), 400).split()
    words = [f"{w}{i}" for i, w in enumerate(words)]
    rows = [(50 - i, " ".join(words[3 * i : 3 * i + 200])) for i in range(40)]
    want = sorted(minhash.brute_force(rows))
    assert sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == want
    assert {r[2] for r in want} == {11}


def test_minhash_rows_that_repeat(spark):
    t = prose(random.Random(1), 50)
    rows = [(1, t, "x"), (1, t, "x"), (2, t, "x"), (None, t, "x"), (3, None, "x"), (4, "", "x")]
    d = spark.createDataFrame(rows, DOCS + ", component_id string")
    got = rows_of(minhash.near_duplicates(d).select("doc_id", "component_id", "kept"))
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True)], key=repr)
    assert sorted((r.doc_id or 0) for r in minhash.deduplicated(d).collect()) == [0, 1, 3, 4]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_minhash_ids_with_several_texts(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "end"])
    rows = [(0, a), (1, a), (1, b), (2, near(b)), (3, near(c)), (4, c), (4, "x y"), (5, "x y"), (5, "q"), (6, "q r s t u v w " * 9000), (7, "q r s t u v w " * 9000 + "z")]
    want = {i: root for i, _, root, _ in minhash.brute_force_ids(rows)}
    assert want == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6}
    d = spark.createDataFrame([(*r, "u", 7) for r in rows], DOCS + ", unit string, content int")
    got = minhash.near_duplicates(d).select("doc_id", "component_id").distinct().collect()
    assert {r[0]: r[1] for r in got} == want and len(got) == len(want)
    # without two texts of one id, the ids apart
    for part in (rows[1:4], rows[:2] + rows[3:5]):
        d = spark.createDataFrame(part, DOCS)
        assert {r[0]: r[1] for r in minhash.near_duplicates(d).select("doc_id", "component_id").collect()} == {i: root for i, _, root, _ in minhash.brute_force_ids(part)}
    # each text by itself
    kept = minhash.deduplicated(spark.createDataFrame([*rows, rows[2], (8, None), (8, " "), (None, a)], DOCS).withColumn("n", F.lit(1)), 80).collect()
    assert sorted(((r.doc_id, (r.text or "").strip()[:20]) for r in kept), key=repr) == sorted([(0, a[:20]), (1, b[:20]), (3, c[:20]), (4, "x y"), (5, "q"), (6, "q r s t u v w q r s t"[:20]), (8, ""), (None, a[:20])], key=repr)


def test_minhash_group_just_under_the_threshold(spark, tmp_path):
    # every two members share 84 % or less of their shingles: nothing links, and no pairs are listed
    rng = random.Random(17)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        t = list(base)
        for at in rng.sample(range(5, 290, 6), 6):
            t[at] = f"x{i}n{at}"
        rows.append((i, " ".join(t)))
    sets = [minhash.shingles(minhash.words_of(t)) for _, t in rows[:40]]
    assert not any(minhash.similar(a, b, 85) for i, a in enumerate(sets) for b in sets[:i])
    work = common.Work(spark, "test")
    d = spark.createDataFrame([(i, minhash.hashed_shingles(minhash.words_of(t)).tobytes()) for i, t in rows], "unit long, items binary")
    assert minhash._prefix_pairs(work, d.select("unit", F.col("unit").alias("component")), d, 85).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.kept for r in got) and len(got) == 400


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    x, y = minhash.signature(a[:800]), minhash.signature(a[100:])
    assert abs((x == y).mean() - 700 / 900) < 0.12


# --- 10 embeddings


def vectors(n=400, d=16):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d))
    for i in range(0, n, 3):
        j = rng.integers(0, 20)
        x[i] = x[j] * rng.uniform(0.5, 2) + rng.standard_normal(d) * rng.choice([0, 0.05, 0.1]) * (i > 20)
    return x


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            return near.sum(1), label
        label = new


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 10)
    x = vectors()
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    n, label = brute_links(x)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(d).collect())
    assert got == [(i, int(n[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))]


def clumps(groups=5, each=120, d=32, apart=0.15):
    """Tight groups, each vector nearer to its own than to the others, all of them linked."""
    rng = np.random.default_rng(4)
    x = np.zeros((groups * each, d))
    x[:, 0] = 1
    x[np.arange(len(x)), 1 + np.arange(len(x)) % groups] = apart
    return x + 1e-3 * rng.standard_normal(x.shape)


@pytest.mark.parametrize("block", [16, 2048])
def test_full_lists_hide_no_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    x = np.concatenate([clumps(), -clumps(2, 30, apart=0.5), vectors(60, 32)])  # the middle two groups do not link
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    n, label = brute_links(x)
    assert n[:600].min() == 599 and len(set(label[600:660].tolist())) == 2
    got = sorted(tuple(r) for r in embeddings.near_duplicates(d).collect())
    assert got == [(i, int(n[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))]


def test_audit_weighs_queries_not_links(spark):
    rng = np.random.default_rng(6)
    hot, far = rng.standard_normal(32) + 1e-3 * rng.standard_normal((300, 32)), np.repeat(rng.standard_normal((60, 32)), 2, 0) + 1e-3 * rng.standard_normal((120, 32))
    x = np.concatenate([hot, far])
    points = spark.createDataFrame([(i, 1, embeddings.unit(v).tobytes()) for i, v in enumerate(x)], "id long, w long, u binary")
    found = lambda n: (spark.createDataFrame([(i, 299 if i < 300 else 1) for i in range(n)], "id long, n_links long"), spark.createDataFrame([(i, 0 if i < 300 else i - i % 2) for i in range(n)], "node long, component long"))
    assert embeddings.audit(points, *found(420), 0.95) == 1
    assert embeddings.audit(points, *found(300), 0.95) == 0  # all pairs outside the hot group are missed
    none = spark.createDataFrame([], "id long, n_links long"), spark.createDataFrame([], "node long, component long")
    assert embeddings.audit(points, *none, 0.95) == 0


def test_many_pairs_beside_a_hot_group(spark, monkeypatch):
    """A dense group larger than a block, part of it far from its centre, and many pairs."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(24)
    tight = centre + 0.1 * rng.standard_normal((500, 24))
    loose = centre + 0.35 * rng.standard_normal((150, 24))
    pairs = np.repeat(rng.standard_normal((100, 24)), 2, 0) + 1e-2 * rng.standard_normal((200, 24))
    x = np.concatenate([pairs, tight, loose, tight[:20]])
    d = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    n, label = brute_links(x)
    assert (n[:200] == 1).all() and n[200:].max() > 500
    got = sorted(tuple(r) for r in embeddings.near_duplicates(d).collect())
    assert got == [(i, int(n[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))]


def test_lists_grow_while_saturated(spark):
    rows = [(1, j, 0.99, 0) for j in range(2, 102)] + [(200, j, 0.99 if j < 20 else 0.5, 0) for j in range(40)] + [(300, j, 0.5, 0) for j in range(40)]
    lists = embeddings._merge(spark.createDataFrame(rows, "id long, nb long, sim float, born int"), 0.95)
    assert {r["id"]: r["count"] for r in lists.groupBy("id").count().collect()} == {1: embeddings.MOST, 200: 2 * embeddings.LIST, 300: embeddings.LIST}


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "audit", lambda *a: 0.5)
    d = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        embeddings.near_duplicates(d)


def test_the_hot_group_does_not_end_the_descent(spark):
    lists = [(i, 100 + j, 0.99, 0) for i in range(50) for j in range(24)] + [(900, 901, 0.97, 2), (901, 900, 0.97, 2), (902, 903, 0.5, 1)]
    df = spark.createDataFrame(lists, "id long, nb long, sim double, born int")
    assert not embeddings._settled(df, 0.95, 2) and embeddings._settled(df, 0.95, 3)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [3.0, 0.1]), (9, [0.0, 1.0])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = rows_of(embeddings.near_duplicates(d))
    links = {(r[0], r[1], r[2]) for r in got}
    assert len(got) == 11
    assert {(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (None, 0, None), (9, 2, 1)} == links
    assert embeddings.near_duplicates(d.limit(0)).count() == 0
