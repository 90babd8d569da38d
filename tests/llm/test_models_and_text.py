"""Toxicity, page extraction, fingerprints and personal data."""

import hashlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from orderlens.llm import extraction, fingerprint, labelled_pages, pii, queries, toxicity
from orderlens.llm.htmlblocks import blocks_of

SF = "/root/testdata/sf0.01"


def test_op1_on_held_out_labels(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    seen = got.merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    seen = seen[seen.held_out]
    assert seen[seen.toxic == 1].predicted.mean() > 0.85
    assert seen[seen.toxic == 0].predicted.mean() < 0.03


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    noise = lambda: rng.integers(100, 400, 20)
    positive = [np.unique(np.append(noise(), 7)) for _ in range(1500)]
    unlabelled = [np.unique(np.append(noise(), 7) if i % 10 == 0 else noise()) for i in range(5000)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    score = lambda f: model.base + model.weights[np.isin(model.known, f)].sum()
    assert np.mean([score(np.unique(np.append(noise(), 7))) > 0 for _ in range(200)]) > 0.9
    assert np.mean([score(np.unique(noise())) > 0 for _ in range(200)]) < 0.05


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0), (7, 0), (2**62, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    assert toxicity.score(odd_docs, model).where("score between 0 and 1").count() == 10
    assert toxicity.score(no_docs, model).collect() == []
    blank = toxicity.train(odd_docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd_docs, blank).collect()} == {0.0}


def test_elements_without_an_end_swallow_no_article():
    said = lambda page: [b.text for b in blocks_of(page)]
    assert said('<p>one <svg viewBox="0"/> two</p><svg><text>no</text></svg><p>three</p>') == ["one two", "three"]
    for tag in ("svg", "template", "select", "iframe"):
        assert said(f"<p>one</p><{tag}><p>two</p><{tag}><p>three</p>") == ["one", "two", "three"]
    assert said("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> says</p><math/><noscript>and more</noscript>") == ["as x=2 says", "and more"]
    assert said("<p>one</p><script>var x = '<p>no</p>';") == ["one"]


def test_field_labels_pages_it_has_not_seen():
    field = extraction.trained()
    right = total = 0
    for seed in range(20_000, 20_150):
        blocks = blocks_of(labelled_pages.page(seed))
        truth = [extraction._label(b) == 1 for b in blocks]
        right += sum(a == b for a, b in zip(field.decode(blocks), truth, strict=True))
        total += len(blocks)
    assert right / total > 0.98


def test_op4_returns_the_articles(spark):
    import html as entities

    got = queries.op4_block_field(spark, SF).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    for p in pages.itertuples():
        article = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")].replace("<br>", " ")
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got.text[p.page_id] == "\n".join(x for x in parts if x)
    assert (got.n_chars == got.text.str.len()).all() and len(got) == len(pages)


def test_blocks_of_broken_markup():
    text = lambda h: [b.text for b in blocks_of(h)]
    assert text("<p>a &lt;b&gt; &amp;amp; c<p>d<br>e <!-- x -->f<script>if (a<b) {}</script>g</p>h") == ["a <b> &amp; c", "d e fg", "h"]
    assert text("a < b <i>c</i>d<div title='x>y'>e</div><title>t</title><p>\n \xa0 </p>") == ["a < b cd", "e"]
    assert text(None) == text("") == text("<div><!-- open") == text("<script>x") == []
    assert text("<li>1<li>2<td>3<td>4") == ["1", "2", "3", "4"]
    assert text('<a href="x>1</a><p>2</p>') != []
    assert len(text("<div>" * 2000 + "x")) == 1


def test_extraction_of_odd_pages(spark):
    rows = [(1, None, None, "a"), (None, "u", "", "b"), (2, "u", "<p>x</p>", "c"), (2, "u", "<p>x</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = extraction.extract(pages)
    assert got.count() == 4 and got.where("page_id = 1 and text = '' and n_chars = 0").count() == 1
    assert extraction.extract(pages.limit(0)).collect() == []


def test_samples_collide_as_often_as_weights_agree():
    rng = np.random.default_rng(3)
    for _ in range(6):
        a, b = (rng.integers(0, 6, 40) for _ in range(2))
        texts = [" ".join(f"t{i}" for i, n in enumerate(x) for _ in range(n)) for x in (a, b)]
        s = fingerprint.signatures(pa.array(texts), 2000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_op6(spark, documents):
    got = queries.op6_weighted_sampling(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    texts = documents.text.tolist()
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    assert got.doc_id.tolist() == documents.doc_id.tolist() and got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    signed = fingerprint.signatures(pa.array(texts + edited))
    assert got.fingerprint.tolist() == [s.tobytes().hex() for s in signed[: len(texts)]]
    assert got.edited_fingerprint.tolist() == [s.tobytes().hex() for s in signed[len(texts) :]]
    assert got.near_edited.mean() > got.near_next.mean() + 0.1
    own = signed[: len(texts)]
    assert np.allclose(got.near_next, (own == np.roll(own, -1, axis=0)).mean(axis=1))


def test_fingerprints_over_borders_and_odd_rows(spark, documents, odd_docs, no_docs):
    docs = spark.createDataFrame(documents[["doc_id", "text"]][:60])
    one = fingerprint.compare_with_next(docs).orderBy("doc_id").collect()
    assert fingerprint.compare_with_next(docs, piece_bytes=3000).orderBy("doc_id").collect() == one
    got = fingerprint.compare_with_next(odd_docs, piece_bytes=100).collect()
    assert len(got) == 10
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 5)} == {"0" * 4 * fingerprint.SAMPLES}
    assert len({r.fingerprint for r in got if r.doc_id in (1, 7)}) == 1
    assert sorted(r.near_next for r in got if r.doc_id == 1)[-1] == 1.0
    assert fingerprint.compare_with_next(no_docs).collect() == []


BASE = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "email", lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "ip", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), "card", lambda s: 12 <= len(d := re.sub(r"\D", "", s)) <= 19 and pii.luhn(d)),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), "phone", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
]


def plain_spans(text):
    found = [(m.start(), m.end(), kind) for p, kind, good in BASE for m in p.finditer(text) if good(m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_op7(spark, documents):
    got = queries.op7_disclosure(spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        spans = plain_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert got.base_sha256[i] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[f"n_{k}"][i] for k in pii.KINDS[:4]] == [sum(s[2] == k for s in spans) for k in pii.KINDS[:4]]
        assert [s for s in got.spans[i].split(",") if s and not s.startswith("term")] == [s for s in joined.split(",") if s]
    assert (got[["n_email", "n_ip", "n_card", "n_phone"]].sum() > 0).all()


def test_patterns_on_hard_texts():
    texts = ["a@b.c_d@e.f", "x%@y.z%@q.r.s", "a@b", "1.2.3.4.5.6.7.8", "1.2.3.999 0001.2.3.4", "@a.b", "é@a.b", "+1 (23) 456-78-90", "4111-1111 1111 1111"]
    for t in [*texts, "".join(texts)]:
        assert pii.find_base(t) == plain_spans(t)
    assert pii.find_base("x" * 300_000 + " " + "1" * 300_000) == []


def test_words_that_disclose_an_entity(spark):
    rows = [(i, f"the agent codename{i % 3 and 'Zebra'} wrote to spy{'' if i % 3 else i}@x.org about it number {'abc'[i % 3] * 3}") for i in range(60)]
    rows += [(100 + i, "the agent wrote about it, to nobody") for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.base, r.terms) for r in pii.find_spans(docs, support=2).collect()}
    assert len(found) == len(rows) and found[900] == ([], [])
    text = rows[1][1]
    named = {text[t.begin : t.stop] for t in found[1][1]}
    assert "codenameZebra" in named and not named & {"the", "agent", "wrote", "about"}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[900] is None and clean[100] == rows[60][1] and "@" not in clean[1]


def test_words_beside_different_values_of_a_kind(spark):
    rows = [(i, f"zuhörer İxél schickt {i} von 10.0.{i}.7 noch\neine zeile mit geheimwort{i}") for i in range(8)]
    rows += [(100 + i, f"schickt noch eine andere zeile mit {i} von hier") for i in range(200)]
    found = {r.doc_id: r.terms for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {rows[3][1][t.begin : t.stop] for t in found[3]} == {"zuhörer", "İxél", "geheimwort"}
    assert not any(found[100 + i] for i in range(200))


def test_op7_finds_terms_in_the_given_documents(spark):
    found = queries.op7_disclosure(spark, "/root/testdata/sf0.1").where("spans like '%term:%'").collect()
    assert found and all(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found)


def test_personal_data_of_odd_rows(spark, odd_docs, no_docs):
    assert pii.find_spans(odd_docs).where("size(base) = 0 and size(terms) = 0").count() == 10
    assert pii.find_spans(no_docs).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        '<a b="x ' * 60_000,
        "x < y <b " * 60_000 + ">",
        "<div>" * 20_000 + "<p>x" * 20_000 + "</div>" * 20_000,
        "<p><button>" + "<q-q>" * 20_000 + "<p>x" * 20_000 + "</z>" * 20_000,
        "".join(f"<div class='c{i}'>" for i in range(20_000)) + "<p>x</p>" * 20_000,
        "<a " + "b" * 500_000 + ">x",
        "<p>" + " <b></b>" * 50_000 + "x<i>y</i>" * 20_000,
        "<!" * 200_000 + "<!--" + "<p>x" * 20_000,
    ],
)
def test_long_odd_pages_take_time_by_their_length(page):
    started = time.process_time()
    extraction.main_text(extraction.trained(), page)
    assert time.process_time() - started < 20


def test_the_chain_sums_what_the_features_list(documents):
    field = extraction.trained()
    for page in pd.read_parquet(f"{SF}/pages.parquet").html[:40]:
        for block in extraction.blocks_of(page):
            weights = [field.weights.get(f, (0.0, 0.0)) for f in set(extraction.features(block))]
            own = field._sum(extraction._of_block(block))
            sums = field._sums(block.inside) if block.inside else (0.0,) * 6
            for c in (0, 1):
                assert own[c] + sums[c] + sums[2 + c] == pytest.approx(sum(w[c] for w in weights))


def test_words_and_entities_by_the_plain_formula(spark, documents):
    """Every word beside every entity, counted one by one."""
    import math
    from collections import defaultdict

    support, together, line_of, n_line, n_text = 2, defaultdict(set), defaultdict(set), defaultdict(int), defaultdict(int)
    texts = documents.text.tolist()
    total = {False: 0, True: len(texts)}
    held, beside = defaultdict(set), []
    for i, text in enumerate(texts):
        spans = pii.find_base(text)
        own, begin, marks = set(), 0, []
        for line in text.split("\n"):
            inside = [s for s in spans if begin <= s[0] <= begin + len(line)]
            marks.append((line, begin, inside))
            begin += len(line) + 1
        for line in dict.fromkeys(text.split("\n")):
            total[False] += 1
            words = {w for _, _, w in pii._words(line)}
            own |= words
            for w in words:
                n_line[w] += 1
        for w in own:
            n_text[w] += 1
        for line, begin, inside in marks:
            for a, b, word in pii._words(line):
                a, b = a + begin, b + begin
                if spans and not any(a < y and x < b for x, y, _ in inside):
                    if inside:
                        beside.append((i, False, line, word, a, b, [n for x, y, k in inside for n in pii.names(k, text[x:y])]))
                    beside.append((i, True, text, word, a, b, [n for x, y, k in spans for n in pii.names(k, text[x:y])]))
            for x, y, k in inside:
                for n in pii.names(k, text[x:y]):
                    held[n, False].add((i, line))
                    held[n, True].add(i)
    for i, whole, unit, word, _, _, names in beside:
        for n in set(names):
            together[n, whole, word].add((i, unit))
            line_of[n, whole, word].add(unit)
    want = defaultdict(dict)
    for i, whole, _, word, a, b, names in beside:
        for n in set(names):
            key, size, count = (n, whole, word), len(held[n, whole]), (n_text if whole else n_line)[word]
            if len(line_of[key]) >= support and total[whole] / size >= 2:
                share = min(math.log(len(together[key]) * total[whole] / (size * count)) / math.log(total[whole] / size), 1.0)
                if share >= 0.9:
                    want[i][a, b] = max(share, want[i].get((a, b), 0.0))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {(t.begin, t.stop): t.share for t in r.terms} for r in pii.find_spans(docs, support=support).collect() if r.terms}
    assert set(got) == set(want) and got
    assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_many_values_in_one_document(spark):
    text = "\n".join(f"write to person{i}@host{i}.org about thing{i} and matter{i}" for i in range(1500))
    one_line = " ".join(f"person{i}@host{i}.org beside{i}" for i in range(3000))
    started = time.process_time()
    assert len(pii._beside(one_line, pii.find_base(one_line))[0]) == 3000 and time.process_time() - started < 5
    docs = spark.createDataFrame([(i, text) for i in range(4)] + [(9, one_line)], "doc_id long, text string")
    found = {r.doc_id: len(r.base) for r in pii.find_spans(docs).collect()}
    assert found == {0: 1500, 1: 1500, 2: 1500, 3: 1500, 9: 3000}
