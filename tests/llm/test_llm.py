import base64
import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlens.llm import chat, decontam, embeddings, html, langid, minhash, mixing, repair, tokens, warc
from twinlens.llm.hashing import shingle_set, similarity_sketch, word_hashes
from twinlens.sources.scratch import scratch_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, doc string, id long, a long"


def docs_of(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, 2) for i, t, lang, s in rows], DOC)


def prose(seed, n, words=300):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(w + "z" if rng.random() < share else w for w in text.split(" "))


def test_word_hashes_by_chunk(monkeypatch):
    text = ("Word ÉTÉ\tx\n" * 50).encode()
    whole = word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr("twinlens.llm.hashing._CHUNK", 7)
    assert (word_hashes(np.frombuffer(text, np.uint8)) == whole).all() and len(whole) == 150
    assert (word_hashes(np.frombuffer(b"WORD x", np.uint8)) == word_hashes(np.frombuffer(b"word\x0bx", np.uint8))).all()


def test_sketch_concentrates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    y = np.concatenate([x[:700], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    assert abs((similarity_sketch(x, 240) == similarity_sketch(y, 240)).mean() - 700 / 1100) < 0.12
    for n in (1, 2, 5):
        assert (similarity_sketch(x[:n], 240) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_near_duplicates_against_brute_force(spark):
    base = [prose(k, 60) for k in range(4)]
    texts = [edited(b, s, 0.03 * (s % 4)) for b in base for s in range(12)] + [None, "", "  \n", "one", "One", "one two", "one two three", prose(9, 5000)] + [base[0]] * 5
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(None, base[0], None, None), (3, texts[3], None, None)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, rows), width=3, threshold=0.85).collect()}

    def of(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())

    sets, root = [of(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert {k: got[k]["component_id"] for k in range(len(texts))} == dict(enumerate(root))
    assert all(got[k]["n_shingles"] == len(sets[k]) for k in range(len(texts)))
    assert (got[None]["component_id"], got[None]["kept"]) == (0, False)
    assert minhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0


def test_near_duplicates_under_one_id_and_without_ids(spark):
    x, y = prose(1, 50), prose(2, 50)
    rows = [(1, x, None, None), (1, y, None, None), (1, y, None, None), (2, edited(y, 3, 0.02), None, None), (None, x.replace("a", "A"), None, None), (None, prose(3, 50), None, None), (None, prose(3, 50), None, None), (None, None, None, None), (4, "", None, None), (4, "", None, None)]
    got = minhash.near_duplicates(docs_of(spark, rows), width=3, threshold=0.7).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"] > 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, False, 0, True), (0, True, 0, True), (0, True, 0, True), (0, True, 1, False), (1, True, 1, True), (1, True, 1, True), (1, True, 1, True), (2, True, 1, False), (4, False, 4, True), (4, False, 4, True),
    ]
    kept = minhash.one_of_each(docs_of(spark, rows), width=3, threshold=0.7)
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [(1, x), (1, y), (None, prose(3, 50)), (None, None), (4, ""), (4, "")]))
    assert minhash.one_of_each(docs_of(spark, rows).limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(14)) for k in range(6)] + [(6, "Short item É"), (7, None), (8, "..."), (0, "w1"), (9, "w2 " * 15)]
    docs = [(k, text(20) + ", " + items[k % 7][1].upper() + "! " + text(9) + (" w2" * (k % 14)), None, None) for k in range(20)] + [(30, None, None, None), (31, "", None, None), (None, items[0][1], None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.decontaminate(docs_of(spark, docs), bench).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {(tuple(w[k : k + min(10, len(w))]), str(i)) for i, t in items for w in [split(t)] if w for k in range(len(w) - min(10, len(w)) + 1)}
    for i, t, _, _ in docs:
        w = split(t)
        hits = {(k, k + len(g), item) for g, item in windows for k in range(len(w) - len(g) + 1) if tuple(w[k : k + len(g)]) == g}
        ids = sorted({x[2] for x in hits})
        want = (len(w), len({p for a, b, _ in hits for p in range(a, b)}), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hits))
        assert got[i] == want
    assert decontam.decontaminate(docs_of(spark, docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs_of(spark, docs).limit(0), bench).count() == 0


def test_decontamination_of_repeated_ids(spark):
    item = [f"w{k}" for k in range(10)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(5, " ".join(item[:5]), None, None), (5, "x x x x x " + " ".join(item[5:]), None, None), (6, " ".join(item), None, None), (6, " ".join(item), None, None), (None, " ".join(item), None, None), (None, None, None, None)]
    got = decontam.decontaminate(docs_of(spark, rows), bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in got) == [(0, 0), (0, 10), (5, 0), (5, 0), (6, 10), (6, 10)]
    kept = decontam.without_contaminated(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 5]


def test_mixing_reaches_targets(spark):
    rows = [(k, "w " * (k % 7 + 1), None, f"s{k % 3}") for k in range(3000)] + [(9001, None, None, None), (9002, "x", None, None), (None, "y y", None, "s1")]
    got = mixing.with_copies(docs_of(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken - target) < 0.1 * target + 5 for target, taken in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.with_copies(docs_of(spark, rows).repartition(3)).collect()), key=str)
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.with_copies(docs_of(spark, rows).limit(0)).count() == 0


def test_language_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        scores = [rng.normal(size=(rng.integers(1, 6), 3)) for _ in range(rng.integers(1, 5))]
        for s, path in zip(scores, langid.best_paths(scores, 0.7), strict=True):
            worth = lambda p: sum(s[k, x] for k, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert worth(path) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=len(s)))))
        one = langid.one_language(scores[0], 2.0)
        assert one is None or (langid.best_paths(scores[:1], 2.0)[0] == one).all()


def test_language_of_mixed_and_scripted_texts(spark):
    rows = [(k, t, lang, None) for k, (t, lang) in enumerate([("the house of the river and the sea", "en"), ("das haus und der fluss ist ein see", "de"), ("дом и река и море", "ru")] * 30)]
    labelled = docs_of(spark, rows)
    model = langid.fit(labelled)
    asked = docs_of(spark, [(1, "the river and the sea das haus und der fluss ist ein see", None, None), (2, None, None, None), (3, "12 ?! ²½ ①", None, None), (4, "море дом", None, None), (5, "", None, None), (None, "the sea " * 20_000, None, None)])
    got = {r["doc_id"]: r for r in langid.identify(asked, model).collect()}
    assert [x[0] for x in json.loads(got[1]["spans"])] == ["en", "de"] and got[1]["lang_pred"] == "de"
    assert [got[k]["lang_pred"] for k in (2, 3, 4, 5, None)] == ["und", "und", "ru", "und", "en"]
    assert langid.identify(asked, langid.fit(labelled.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_held_out_accuracy(spark):
    from twinlens.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op2_language_id(spark, sf).where("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.98


def test_pieces_and_chunks_equal_the_library():
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", " <|endoftext|>", "<|endoftext|>", "é", "1", "'s", " word", "日本", "\x1c", "\x1f", "\r\n", "x" * 50, "\0", "\0 ", ".", ",", '"', "²", "Ж", " don't.", "!?"]
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        known = tokens.Vocabulary(public_tokenizers.path(name))
        for text in ("a \0  b", "\0", "\0 ", " \0  ", "\x1c a\x1f", "\x1d", "a " * 20_000 + "b,"):
            assert np.frombuffer(known.encoded(text), "<u4").tolist() == known.ids(text)
        for _ in range(150):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
            assert np.frombuffer(known.encoded(text), "<u4").tolist() == known.ids(text)
            assert tokens.resynchronised(text, known, 40, 4) == known.ids(text)


def test_token_counts_edges(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.token_counts(docs_of(spark, [(1, None, None, None), (2, "", None, None), (3, "é é", None, None), (4, "word " * 20_000, None, None)])).collect()}
    assert got[1] == got[2] == (0, 0, False) and got[3][0] == 5 and got[4][2]


def most_repeats(symbols, starts):
    """How often the most frequent pair of neighbours stands in a document, overlaps apart."""
    seen = {}
    for k, pair in enumerate(itertools.pairwise(symbols)):
        n, last = seen.get(pair, (0, -2))
        if k + 1 not in starts and not (pair[0] == pair[1] and last == k - 1):
            seen[pair] = (n + 1, k)
    return max((n for n, _ in seen.values()), default=0)


def test_grammar_round_trip():
    rng = random.Random(8)
    for _ in range(100):
        ids = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 80))], dtype=np.uint32)
        starts = np.unique([0] + [rng.randint(0, len(ids) - 1) for _ in range(3)]) if len(ids) else np.array([], int)
        rules, symbols, at = repair.compress(ids, starts, 2)
        grammar = repair.Grammar(rules)
        assert most_repeats(symbols.tolist(), set(at.tolist())) < 2
        assert (grammar.expand(symbols) == ids).all() and len(at) == len(starts)
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(symbols)][: len(at)], strict=True)):
            own = ids[starts[k] : np.append(starts[1:], len(ids))[k]]
            assert (grammar.decode_range(symbols[a:b], 0, len(own)) == own).all()
            if len(own) > 2:
                assert (grammar.decode_range(symbols[a:b], 1, len(own) - 1) == own[1:-1]).all()


def test_shards_round_trip(spark):
    rows = [(5, "word one two", None, None), (2, None, None, None), (9, "z " * 4000, None, None), (1, "", None, None), (9, "z " * 4000, None, None)]
    got = repair.encode_and_read(docs_of(spark, rows)).orderBy("doc_id", "start").collect()
    known, at = tokens.vocabulary(tokens.default_vocabulary()), 0
    for r, (i, t, _, _) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = np.array([*known.ids(t or ""), 0], dtype="<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair.encode_and_read(docs_of(spark, rows).limit(0)).count() == 0


def test_columns_equal_the_library():
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", " <|endoftext|>", "<|endoftext|>", "<|", "|>", "endoftext", "é", "×", "÷", "1", "'s", "'", "'LL", " word", "日本", "\x1c", "\r\n", "\0 ", ".", ",", '"', "²", "½", "Ж", "\u0482", "\u0300", "\u0085", "\u00a0", "\u3000", "…", "“", " don't.", "!?"]
    known = tokens.Vocabulary(tokens.default_vocabulary())
    for _ in range(600):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 12))]
        column = pa.array(texts, pa.string()).slice(rng.randint(0, len(texts)))
        ids, ends = known.encoded_column(column)
        assert len(ends) == len(column)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [known.ids(x or "") for x in column.to_pylist()]


def test_words_reach_the_library_once(monkeypatch):
    words = ["".join(c) for c in itertools.product("bdfg", "aeou", "lmnr", "stxé")]
    texts = [" ".join(w + tail for w in words) for tail in ("", ",", ".", "!\"", "7", ".\nThe", ")...", ";")]
    known = tokens.Vocabulary(tokens.default_vocabulary())
    want = [known.ids(x) for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encoded_together(texts)] == want
    assert len(known._known) < len(words) + 20
    monkeypatch.setattr(tokens, "CACHE", 5)
    monkeypatch.setattr(tokens, "_WINDOW", 50)
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encoded_together(texts)] == want


def test_shards_close_at_their_size(spark):
    rows = [(k, " ".join(["word", "other", "third"][: k % 4]) * (k % 7), None, None) for k in range(200)]
    want = {}
    known = tokens.vocabulary(tokens.default_vocabulary())
    for k, t, _, _ in rows:
        want[k] = known.ids(t)
    out = scratch_path(spark, "test-shards")
    repair.write_shards(docs_of(spark, rows), out, shard_ids=64)
    got = repair.read_shards(spark, out).collect()
    assert {r["doc"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {k: [*v, 0] for k, v in want.items()}
    sizes = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["shard"], r["ordinal"])):
        sizes[r["shard"]].append(r["n_ids"])
    assert len(sizes) > 5 and all(sum(v[:-1]) < 64 for v in sizes.values())


def test_grammar_without_places_in_keys(monkeypatch):
    rng = random.Random(9)
    ids = np.array([rng.randint(0, 5) for _ in range(3000)], dtype=np.uint32)
    both = []
    for bits in (63, 0):
        monkeypatch.setattr(repair, "_KEY_BITS", bits)
        both.append(repair.compress(ids, np.array([0, 700])))
    assert all((a == b).all() for a, b in zip(*both, strict=True))
    assert (repair.Grammar(both[0][0]).expand(both[0][1]) == ids).all()


def test_html():
    page = "<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use</div><article><h1>Head &amp; tail</h1><p>One  two\n<b>three</b><p>Four<br>five<form>no</form><div id=comments>reader</div></article><aside>side</aside><footer>&copy; x</footer>"
    assert html.main_text(page) == "Head & tail\nOne two three\nFour five"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><!-- x") == ""
    plain = "<div><a href=a>one</a> <a href=b>two</a></div><p>" + "text " * 40 + "<p>" + "more " * 40 + "<div><a href=c>three</a></div>"
    assert html.main_text(plain) == ("text " * 40).strip() + "\n" + ("more " * 40).strip()


def test_html_weighs_text_outside_articles():
    body, more, lead, reader = (" ".join([w] * 40) for w in ("body", "more", "lead", "reader"))
    cards = f"<div class=post><p>{body}<p>{more}</div><article><a href=x>Card one</a></article><article><a href=y>Card two</a></article>"
    assert html.main_text(cards) == f"{body}\n{more}"
    comments = f"<div class=post><p>{body}</div><section><article class='comment'><p>{reader}</article><article role=complementary>{reader}</article></section>"
    assert html.main_text(comments) == body
    assert html.main_text(f"<p>{lead}</p><article><h1>Head</h1><p>{body}</p></article><div>&copy; x</div>") == f"{lead}\nHead\n{body}"
    assert html.main_text(f"<article class='category-social tag-search'><p>{body}</article>") == body


def test_html_ignores_names_of_wrappers():
    body, side, reader = (" ".join([w] * n) for w, n in (("body", 90), ("side", 30), ("reader", 400)))
    for name in ("layout-with-sidebar", "has-sidebar", "page no-ads", "content-header", "nav"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<p>{body}</p>", f"<div class=header><p>{body}</p></div>"):
            assert html.main_text(f"<p><a href=x>Slogan</a></p><div class='{name}'>{inner}<div class=sidebar>{side}</div></div>") == body
    assert html.main_text(f"<article><p>{body}</article><div id=comments><article>{reader}</article></div>") == body
    assert html.main_text(f"<p>{body}</p><div id=comments><p>{reader}</div>") == body
    parts = f"<div class=header><p>{body}</div><div class=widget><p>{body}</div>"
    assert html.main_text(parts) == f"{body}\n{body}"
    assert html.main_text(f"<p>Short.</p><div class=cookie-notice>{side}</div>") == "Short."


def plain_blocks(page):
    """Blocks of the article of a well-formed page, by the standard library's parser: an independent way to the same text."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.buffer = [], [], ""

        def flush(self):
            text = " ".join(self.buffer.split())
            if text:
                self.out.append(text)
            self.buffer = ""

        def off(self):
            return any(tag in ("script", "style", "form", "nav", "aside", "footer") or "comment" in names or "ad" in names.split() for tag, names in self.open)

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.buffer += " "
                return
            if tag in ("p", "h1", "h2", "h3", "div", "ul", "ol", "li", "blockquote", "section", "form", "aside", "nav", "table", "tr", "td", "pre", "figure", "figcaption"):
                self.flush()
                if tag == "p" and self.open and self.open[-1][0] == "p":
                    self.open.pop()
            if tag not in ("img", "hr", "meta", "link", "input"):
                self.open.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id"))))

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.open):
                if tag not in ("b", "i", "a", "span", "em", "strong", "code"):
                    self.flush()
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.open) and not self.off():
                self.buffer += data

    parser = Blocks()
    parser.feed(page)
    parser.flush()
    return "\n".join(parser.out)


def test_html_of_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r["page_id"]: plain_blocks(r["html"] or "") for r in pages.collect()}
    got = html.extract(pages.withColumn("text", F.lit("x")).withColumn("id", F.lit(1))).collect()
    assert len(got) == len(truth)
    same = [r["text"] == truth[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got]
    assert sum(same) == len(same)


def test_html_rows_and_depth(spark):
    body = " ".join(["body"] * 90)
    rows = [(1, "u", f"<article><p>{body}</article>")] * 2 + [(2, None, None), (None, "v", ""), (3, "w", "<div>" * 100_000 + f"<p>{body}"), (4, "w", "<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000 + f"<li>{body}")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(body)), (1, len(body)), (2, 0), (3, len(body)), (4, len(body))]
    assert html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0
    assert html.main_text(f'<article><p>{body}<p class="related-work">{body}<div class="share-price">{body}</div><div class="share-buttons">{body}</div></article>') == "\n".join([body] * 3)
    assert html.main_text(f"<p title=\"never closed>{body}</p><p>{body}</p>") == f"{body}\n{body}"


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (3, "v", None), (4, "v", ""), (5, "w", "z\r\n\r\nWARC/1.1\r\n" * 9000), (None, None, "é")]
    got = {r["page_id"]: r for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=1000).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert (got[3]["refers_to"], got[4]["payload_bytes"]) == (4, 0) and got[5]["payload"] == rows[4][2].encode() and got[None]["payload"] == "é".encode()
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_warc_of_every_page_against_hashlib(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += [(900 + k, "u", rows[k % 3][2]) for k in range(9)] + [(950, "v", "long " * 30_000)] * 2 + [(951, "v", "long " * 30_000), (950, "w", "other " * 30_000), (952, None, ""), (953, None, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, id long, sha string")
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i, largest.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw, leader = (h or "").encode(), largest[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == leader else "revisit", None if i == leader else leader))
    for size in (1000, 32_768):
        got = warc.archive_and_read(table, segment_bytes=size, file_bytes=100_000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_tool_calls(spark):
    schema = {"f": {"properties": {"x": "integer", "s": "string"}, "required": ["x"]}}
    calls = spark.createDataFrame(
        [(1, "a", "f", '{"s":"t","x":1}', 0, None), (1, "b", "f", '{"x":"no"}', 2, ["a"]), (1, "c", "g", "{}", 4, ["zz"]), (2, "p", "f", '{"x":1}', 0, ["q"]), (2, "q", "f", '{"x":1}', 2, []), (2, "r", "f", '{"x":2,"y":1}', 3, ["s"]), (2, "s", "f", '{"x":2}', 4, ["r"]), (None, None, "f", "broken", 0, [])],
        "conv long, call string, name string, arguments string, position long, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", "late", 3), (1, "a", "first", 1), (2, "q", "before", 1)], "conv long, call string, content string, position long")
    got = {r["call"]: r for r in chat.link_tool_calls(calls, results, schema).collect()}
    assert {k: (r["linked"], r["valid"], r["level"]) for k, r in got.items()} == {"a": (True, True, 0), "b": (False, False, 1), "c": (False, False, 0), "p": (False, True, 1), "q": (False, True, 0), "r": (False, False, None), "s": (False, False, None), None: (False, False, 0)}
    assert got["a"]["record"] == '{"arguments":{"s":"t","x":1},"call_id":"a","depends_on":[],"name":"f","result":"first"}'
    assert chat.link_tool_calls(calls.limit(0), results, schema).count() == 0


def test_levels_of_random_graphs(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for conv in range(12):
        n = 40 if conv else 200
        order = rng.sample(range(n), n)
        deps = {c: ([order[k - 1]] if conv == 0 else rng.sample(order[:k], min(k, rng.choice([0, 1, 1, 2])))) if k else [] for k, c in enumerate(order)}
        level = {}
        for c in order:
            level[c] = 1 + max((level[d] for d in deps[c]), default=-1)
        if conv == 5:  # a cycle of three, and one behind it
            deps |= {100: [101], 101: [102], 102: [100], 103: [102, order[0]]}
            level |= dict.fromkeys((100, 101, 102, 103))
        rows += [(conv, str(c), "f", "{}", c, [str(d) for d in ds]) for c, ds in deps.items()]
        want |= {(conv, str(c)): x for c, x in level.items()}
    calls = spark.createDataFrame(rows, "conv long, call string, name string, arguments string, position long, depends_on array<string>")
    results = spark.createDataFrame([], "conv long, call string, content string, position long")
    got = chat.link_tool_calls(calls, results, {"f": {}}).collect()
    assert {(r["conv"], r["call"]): r["level"] for r in got} == want


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 16))
    rows = [(k, (base[k % 6] + rng.normal(size=16) * 0.3 * (k % 3)).tolist()) for k in range(120)]
    rows += [(200 + k, rows[0][1]) for k in range(5)] + [(300, None), (301, [0.0] * 16), (302, [float("inf")] * 16), (303, [1.0, 2.0]), (304, [2.0, 4.0]), (305, [])]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int"), block_dims=4, chunk=10).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and np.isfinite(v).all() and np.any(v)]
    links = {(i, j) for (i, x), (j, y) in itertools.combinations(good, 2) if len(x) == len(y) and x @ y >= 0.9}
    root = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i, _ in rows} == {i: (sum(i in p for p in links), root[i]) for i, _ in rows}


def test_near_vectors_gives_a_row_per_input_row(spark):
    x, y = [1.0, 0.0, 0.0, 0.0], [0.99, 0.1, 0.0, 0.0]
    rows = [(1, x), (1, x), (1, [2.0, 0.0, 0.0, 0.0]), (2, y), (3, None), (3, None), (None, x), (None, x), (None, None), (None, None)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_dims=2).collect()
    expected = [(1, 1, 1, True)] * 3 + [(2, 1, 1, False)] + [(3, 0, 3, True)] * 2 + [(None, 0, None, True)] * 4
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    item = prose(50, 12)
    en, de = "the house of the river ", "das haus und der fluss "
    rows = [(k, (en if k % 2 else de) * 3 + prose(k, 60), "en" if k % 2 else "de", f"s{k % 2}") for k in range(20)]
    rows += [(None, rows[5][1], "en", "s1"), (6, prose(90, 60), "de", "s0"), (None, prose(91, 20) + " " + item, "en", "s0")]
    rows += [(100, rows[3][1], "en", "s1"), (101, edited(rows[4][1], 1, 0.01), "de", "s0"), (102, prose(77, 30) + " " + item, "en", "s0"), (103, "?!", "en", "s0"), (104, None, None, None)]
    docs_of(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda d: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in d.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert ids(docs) == sorted([*range(20), 6])
    empty = docs_of(spark, []).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_batches_of_texts_are_small_unless_the_session_has_a_size(spark):
    from twinlens.llm.memory import _BATCH_SETTING, BATCH, small_batches

    spark.conf.set(_BATCH_SETTING, "1048576")
    small_batches(spark)
    assert spark.conf.get(_BATCH_SETTING).rstrip("b") == "1048576"
    spark.conf.unset(_BATCH_SETTING)
    small_batches(spark)
    assert spark.conf.get(_BATCH_SETTING).rstrip("b") == str(BATCH)
    texts = spark.createDataFrame([(k, "ab " * 200_000) for k in range(40)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    got = [r["size"] for r in texts.mapInArrow(sizes, "size long").collect()]
    assert len(got) > 1 and max(got) < 2 * BATCH
