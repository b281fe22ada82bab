"""Operators on documents against brute force, on small fixtures with every kind of odd row."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import class_model, common, language, minhash, mixing, packing, personal_data
from corpusmill.llm.queries import QUERIES, fold

BASE = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven small birds sing"
TEXTS = [
    (1, BASE, "en", "b"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " loudly", "en", None),
    (4, "", None, "a"), (5, None, "en", "a"), (6, "   ", "en", "c"), (7, "one two", "en", "c"), (8, "One  TWO", "en", "c"),
    (9, "1234 !! ##", "en", "c"), (None, "a row without an id but with words enough to count", None, None),
    (10, "word " * 5000, "en", "b"), (11, "le chat dort sous la table de la cuisine", "fr", "b"), (12, "x" * 20000, "fr", "b"),
    (13, "mail me at a.b@c.example.com or +1 (523) 555-1055 é 4111 1111 1111 1111 10.0.0.255", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, "extra", "kept") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_id string, ids string").repartition(3)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """Smallest linked id by comparing all pairs; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return [min(groups[find(i)], key=lambda d: (d is None, d)) for i in range(len(rows))]


def test_near_duplicates(docs):
    found = minhash.near_duplicates(docs).collect()
    expected = Counter((d, len(shingles(t)), c) for (d, t, *_), c in zip(TEXTS, components([(d, t) for d, t, *_ in TEXTS])))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert sum(r.chosen for r in found) == len({(r.component_id) for r in found})
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.chosen for r in found)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_parts_of_batches():
    texts = ["a" * n for n in (3, 0, 5, 20, 1, 1, 1)] + [None]
    batch = pa.record_batch([pa.array(texts), pa.array(range(8))], names=["t", "i"])
    parts = [p.column(1).to_pylist() for p in common.parts_of(batch, 8)]
    assert parts == [[0, 1, 2], [3], [4, 5, 6, 7]]
    assert list(common.parts_of(batch.slice(0, 0))) == []


def test_numbers_without_letters_have_no_language():
    assert [language.letters(t) for t in ("½ ²", "①", "Ⅷ 12", "½a")] == ["", "", "", " a "]


def test_near_duplicates_in_one_bucket(spark):
    """A large group of near copies, and members that only link with members that are not the centre."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            copy[at] = f"v{rng.integers(0, 50)}"
        rows.append((i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()}
    assert [found[i] for i, _ in rows] == components(rows)


def test_class_model(docs):
    held = docs.select("doc_id", "text", (fold(7) == 2).alias("held_out"))
    found = class_model.score(held, n_classes=4, rounds=2, known_words=8, own_units=4).collect()
    assert len(found) == len(TEXTS)
    training = [t for d, t, *_ in TEXTS if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    expected = sorted((len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), b""]),
                       round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), b""]), 6)) for _, t, *_ in TEXTS)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {n} and all(r.score < 0 for r in found)
    assert class_model.score(held.limit(0)).count() == 0


def test_class_model_against_plain_sums(spark):
    """Classes around each word, the class it moves to, the probabilities and each document's score."""
    n_classes = 5
    texts = [f"a{i % 3} b{i % 5} c{i % 2} rare{i // 2} a{i % 3} seldom{i % 9} b{i % 4}" for i in range(40)] + ["", None, "rare1 " + "b1 a2 " * 500]
    texts += ["a1 unheard rare1 b2 rare3 unheard", "rare1 rare1 seldom2", "zz"]
    rows = [(i, t, i >= 43) for i, t in enumerate(texts)] + [(0, texts[0], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    counts = class_model.word_counts(docs)
    lexicon = class_model.lexicon(counts, 12, 4)
    written = class_model.encoded(docs, lexicon)
    training = written.where("not held_out")
    classes = class_model.cluster(training, lexicon, n_classes, 2)
    found = class_model.assigned(training, lexicon, classes, n_classes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # words go on in the next batch
    try:
        again = class_model.assigned(training, lexicon, classes, n_classes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))

    end = n_classes - 1
    unit_class = lambda w: end if w == b"" else int(classes[lexicon.unit(w)])
    own = {w for w, u in lexicon.units.items() if class_model.ENDINGS <= u < lexicon.n_units - 1}
    tokens = [[*words(t), b""] for _, t, held in rows if not held]
    grid, around = np.zeros((n_classes, n_classes)), defaultdict(Counter)
    for line in tokens:
        for i, word in enumerate(line):
            before = unit_class(line[i - 1]) if i else end
            grid[before, unit_class(word)] += 1
            if word and word not in own:
                around[word][before] += 1
                around[word][n_classes + unit_class(line[i + 1])] += 1
    counted = defaultdict(Counter)
    for r in class_model.context_counts(training, lexicon, classes, n_classes).collect():
        counted[bytes(r.word)].update(dict(zip(np.frombuffer(r.codes, np.uint16).tolist(), np.frombuffer(r.ns, np.uint32).tolist())))
    assert counted == around and len(counted) > 20 and 0 < len(lexicon.others) < len(counted)
    sizes, total = grid.sum(axis=1), grid.sum()
    steps = (grid + (sizes + 1) / (total + n_classes)) / (sizes[:, None] + 1)
    kind = {b"": end, **{w: unit_class(w) for w in own}}
    chosen = {bytes(r.word): r.kind for r in found.collect()}
    assert chosen.keys() == around.keys()
    for word, seen in around.items():
        n = sum(v for code, v in seen.items() if code >= n_classes)
        gain = [sum(v * math.log10(steps[c, k] if c < n_classes else steps[k, c - n_classes]) for c, v in seen.items())
                - n * math.log10(sizes[k] + 1) for k in range(end)]
        assert gain[chosen[word]] >= max(gain) - 1e-9
        kind[word] = chosen[word]

    train = Counter(w for line in tokens for w in line)
    grid = np.zeros((n_classes, n_classes))
    for line in tokens:
        for before, word in zip([b"", *line], line):
            grid[kind[before], kind[word]] += 1
    sizes = grid.sum(axis=1)
    steps = (grid + (sizes + 1) / (sizes.sum() + n_classes)) / (sizes[:, None] + 1)
    types = Counter(kind.values())
    emission = 1 / (sizes + [types[k] for k in range(n_classes)] + 1)
    mass = emission.copy()
    for word, k in kind.items():
        mass[k] += (train[word] + 1) * emission[k]
    assert np.allclose(steps.sum(axis=1), 1.0) and np.allclose(mass, 1.0)

    def plain_score(text):
        line, result = [*words(text), b""], 0.0
        for before, word in zip([b"", *line], line):
            a, b = (kind.get(w, unit_class(w)) for w in (before, word))
            result += math.log10(steps[a, b] * emission[b] * (train[word] + 1))
        return result

    scored = class_model.score(docs, n_classes, 2, 12, 4).collect()
    assert len(scored) == len(rows)
    for r in scored:
        assert abs(r.score - plain_score(texts[r.doc_id])) < 1e-6 * max(1.0, abs(r.score)), r.doc_id


def test_class_model_beats_words(spark, sf_dir):
    found = [r for r in QUERIES["op2_class_model"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_language(spark, docs, sf_dir):
    model = language.fit(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (4, 5, 6, 9)) and found[11][0] == "fr" and found[1][0] == "en"
    assert language.predict(docs, language.fit(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in QUERIES["op6_language"](spark, sf_dir).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.95


def test_long_texts_are_read_whole():
    buckets = [b for block in language.ngram_buckets(language.letters("ab " * 200_000)) for b in block]
    assert len(buckets) == sum(600_000 - order for order in range(3)) + 3 * (len(language.letters("ab " * 200_000)) - 600_000)


def test_mixing(docs):
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source in TEXTS:
        sizes[source] += len(words(text))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    open_, left, target = dict(weights), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if 2 * sizes[s] <= level * open_[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        assert all(0.0 <= p <= 1.0 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    assert taken == Counter({s: math.floor(target[s]) for s in target})
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in found}
    copies = mixing.training_documents(docs)
    assert copies.columns == docs.columns
    assert sum(len(words(r.text)) for r in copies.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert sorted(packing.hilbert_key(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, 64).collect()
    expected = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, *_ in TEXTS)
    joined = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
        joined[p.sequence_id].append(p)
    stream, whole = [], []
    for number, sequence in sorted(joined.items()):
        assert [p.offset for p in sequence] == list(np.cumsum([0] + [p.length for p in sequence[:-1]]))
        stream += sequence
    for p in stream:  # a document's pieces lie one after the other
        if p.start == 0:
            whole.append([])
        whole[-1] += p.ids
    assert Counter(map(tuple, whole)) == expected
    assert sum(p.length for p in pieces) > 64 * (len(joined) - 1)
    assert packing.pack(docs.limit(0), path).count() == 0


def luhn(digits):
    return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans(text):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, docs):
    import random

    rng = random.Random(3)
    parts = ["a", "1", "22", "@", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "😀", "_", "a@b.c", "1.2.3"]
    texts = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(400)]
    texts += [t for _, t, *_ in TEXTS] + ["1" * 30_000 + " " + "1." * 3000 + " " + "12-" * 3000 + "x@" + "a." * 3000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in personal_data.digest(personal_data.find(table)).collect():
        if not row.n_added:
            assert row.spans == spans(texts[row.doc_id])
    clean = personal_data.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    text = next(r.text for r in clean.collect() if r.doc_id == 13)
    assert text == "mail me at [email] or [phone] é [card] [ip]"
    assert personal_data.find(docs.limit(0)).count() == 0


def test_contexts_reveal_unseen_identifiers(spark):
    seeds = [(i, f"please call my office +1 ({200 + i}) 555-{1000 + i} today") for i in range(60)]
    unseen = [(100, "please call my office 555-123-4567 today"), (101, "version 555-123-4567 shipped on time")]
    rows = {r.doc_id: r for r in personal_data.digest(personal_data.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))).collect()}
    assert rows[100].spans == "phone:22:34" and rows[100].n_phone == 0 and rows[101].spans == ""


def test_spans_are_redacted_where_they_stand(spark):
    many = " ".join(f"é{i} +33.1.42.68.53.{i % 90 + 10}, a{i}@b.org" for i in range(600))
    texts = ["call +33.1.42.68.53.00 now", "no data", "", None, "😀 1.2.3.4", "a@1.2.3.4 and 1.2.3.4", many]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert [clean[i] for i in range(6)] == ["call [phone] now", "no data", "", None, "😀 [ip]", "[email] and [ip]"]
    assert clean[6] == " ".join(f"é{i} [phone], [email]" for i in range(600))


def test_held_out_rows_choose_no_units(spark):
    training = [(i, f"the a{i % 7} of b{i % 5} and c{i % 3}", False) for i in range(60)]
    held = [(100 + i, "zebra yak xenon zebra yak a1 a1 a1", True) for i in range(50)]
    alone, both = (class_model.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), 4, 2, 8, 6)
                   for rows in (training, training + held))
    expected = {r.doc_id: r.score for r in alone.collect()}
    found = {r.doc_id: r.score for r in both.collect() if not r.held_out}
    assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-9 for i in found)
    counts = class_model.word_counts(spark.createDataFrame(training + held, "doc_id long, text string, held_out boolean"))
    lexicon = class_model.lexicon(counts, 8, 6)
    assert all(lexicon.unit(w) == class_model.ending_of(w) for w in (b"zebra", b"yak", b"xenon", b"unheard"))


def test_capitals_with_marks_are_encoded_as_by_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path) as file:
        encoder = packing.ChunkEncoder(file.read())
    texts = [f"An {chr(c)}{chr(m)}x, {chr(c)}{chr(m)} END." for c in range(65, 91) for m in range(0x300, 0x370)]
    texts += [f"{chr(c)}\u0323{chr(m)}" for c in range(65, 91) for m in range(0x300, 0x370)] + ["PLAIN, Été!", "J\u030c. K."]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert list(ids) == [*library.encode(text, add_special_tokens=False).ids, 1], ascii(text)


def test_words_are_numbered_and_counted_in_parts(spark, monkeypatch):
    texts = ["The dog the", "  a  b\x0b\x0cA\n", "", None, " ", "x" * 70 + " y " + "X" * 70, "dog \u00c9 \u00e9 \x1c \x85 \u2003 q", "the " * 40]
    row, word, names = class_model._split(pa.array(texts, pa.string()))
    names = names.to_pylist()
    assert len(set(names)) == len(names)
    found = [[names[w] for r, w in zip(row, word) if r == i] for i in range(len(texts))]
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [[w if len(w) <= 64 else None for w in p] for p in plain] == [[None if w[:1] == b"\xff" else w for w in f] for f in found]
    assert found[5][0] == found[5][2] != found[5][1] and len(found[5][0]) == 17

    docs = spark.createDataFrame([(t, i % 3 == 1) for i, t in enumerate(texts)], "text string, held_out boolean").coalesce(1)
    expected = {w: [0, 0] for w in [b"", *itertools.chain(*found)]}
    for i, words in enumerate(found):
        for w in [*words, b""]:
            expected[w][i % 3 == 1] += 1
    for held_text, held_bytes in ((1 << 24, 1 << 20), (1, 1)):
        monkeypatch.setattr(class_model, "HELD_TEXT", held_text)
        monkeypatch.setattr(class_model, "HELD_BYTES", held_bytes)
        counts = {bytes(r.word): [r.train, r.held] for r in class_model.word_counts(docs).collect()}
        assert counts == expected


def test_a_chunk_is_looked_up_once_however_often_it_occurs():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path) as file:
        encoder = packing.ChunkEncoder(file.read())

    class Counted(dict):
        asked = 0

        def __getitem__(self, chunk):
            self.asked += 1
            return super().__getitem__(chunk)

    encoder.known = Counted(encoder.known)
    texts = ["The dog, the DOG.\x0b\x0c  the\x1cdog ", " \n", "", None, "<|the dog|> the", "\u00c9t\u00e9 A\u0301 the " + "x" * 90] * 50
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert list(ids) == [*library.encode(text or "", add_special_tokens=False).ids, 1], ascii(text)
    assert encoder.known.asked <= 12


def test_identifiers_are_reached_in_turns(spark):
    def found(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id: r.spans for r in personal_data.digest(personal_data.find(docs)).collect()}

    seeds = [f"please call my office +1 ({200 + i}) 555-{1000 + i} today" for i in range(60)]
    # Seven identifiers no base pattern finds do not speak against their own pattern; one holds spaces.
    unseen = [f"please call my office 555-123-45{10 + i} today" for i in range(6)] + ["please call my office (020) 7946 0018 today"]
    # A pattern with three of those and three seeds, and one with five of those and no seed, reach others.
    second = [f"her mobile number 555-123-45{10 + i} works" for i in range(3)]
    second += [f"her mobile number +1 ({300 + i}) 555-1000 works" for i in range(3)] + ["her mobile number 555-999-0001 works"]
    third = [f"reach them under 555-123-45{10 + i} always" for i in range(5)] + ["reach them under 555-999-0002 always"]
    other = ["version 555-123-9999 shipped on time", "please call my lawyer 555-123-8888 instead"]
    texts = seeds + unseen + second + third + other
    spans = found(texts)
    for i, text in enumerate(texts):
        start = re.search(r"[+(]?[0-9]", text).start()
        end = max(m.end() for m in re.finditer("[0-9]", text))
        assert spans[i] == ("" if text in other else f"phone:{start}:{end}"), text
    cards = [f"paid with card {4111111111110000 + i:d} online" for i in range(400)]
    cards = [t for t in cards if luhn(t.split()[3])]
    spans = found([*cards, "paid with card 4111 1111 1111 1112 online"])
    assert len(cards) >= 20 and spans[len(cards)] == "card:15:34"
    # Values that look otherwise do contradict: these are order numbers.
    mixed = [t.replace("office", "desk") for t in seeds[:20]] + [f"please call my desk AB-{1000 + i}x today" for i in range(20)]
    spans = found([*mixed, "please call my desk 555-123-4567 today"])
    assert spans[len(mixed)] == ""
