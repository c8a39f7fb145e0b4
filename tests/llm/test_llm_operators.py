"""The other operators against brute force, round trips, held-out accuracy and cases at the edge."""

import hashlib
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat, decontaminate, licenses, lines, neighbours, quality, simhash
from ledgerlens.llm.common import hash_bytes

SF_DIR = "/root/testdata/sf0.001"
RANKS = bpe.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LONG = ("Some words, and a number 1234; " * 9000).strip()
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "short"), (5, LONG), (6, "twice the same words in this line"), (6, "twice the same words in this line"), (7, "Twice the SAME words, in this line!"), (None, "twice the same words in this line"), (8, "x" * 200_000), (9, "é   naïve\x00 text"), (None, None)]


def edge_docs(spark):
    return spark.createDataFrame([(*r, 0.5, 1, "k", 2, 3, "q") for r in EDGE], "doc_id long, text string, score double, fp long, id string, th int, gone int, removed_lines string")


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# 1: quality


def test_quality_learns_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_of_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 7)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, score string")
    got = quality.quality_scores(edge_docs(spark), labels)
    assert got.count() == len(EDGE) and got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.quality_scores(edge_docs(spark), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.quality_scores(edge_docs(spark).limit(0), labels).count() == 0
    assert quality.keep_good(edge_docs(spark), labels.limit(0)).columns == edge_docs(spark).columns


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, i % 2 + 1]) for i in range(40)]
    labels = np.array([float(i % 2) for i in range(40)])
    model = quality.Model.fit(rows, labels)
    again = quality.Model.unpacked(model.packed())
    assert model.score(rows[1]) > 0.8 > 0.2 > model.score(rows[0]) and abs(again.score(rows[1]) - model.score(rows[1])) < 1e-4


# 2: neighbours


def test_neighbours_match_brute_force(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None, *[0.0] * 6]), (2003, [float("nan"), *[0.0] * 7]), (2004, [float("inf"), *[0.0] * 7]), (2005, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, rep int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where(F.col("vec_id") % 10 == 0).select("vec_id"), leaf=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [i for i, _ in rows if i % 10 == 0]
    found = total = 0
    for i, v in rows:
        if i % 10 == 0:
            want = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in rows if j != i)[:10]
            assert len(got[i]) == 10 and [s for _, s in got[i]] == sorted(s for _, s in got[i])
            found, total = found + len({j for _, j in want} & {j for j, _ in got[i]}), total + 10
    assert found / total >= 0.9
    assert [j for j, _ in got[0]] == [1000 + i for i in range(10)]


def test_neighbours_of_few_or_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df, df.select("vec_id")).orderBy("query_id").collect()] == [(1, 1, 2), (2, 1, 1)]
    assert neighbours.nearest(df.limit(0), df.select("vec_id").limit(0)).count() == 0


# 3: byte-level BPE


def test_bpe_matches_the_library_and_round_trips(spark):
    codec = bpe.Codec.of(RANKS)
    for docs in (edge_docs(spark), documents(spark)):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode_documents(docs, RANKS).collect())
        want = Counter()
        for r in docs.collect():
            ids = codec.encoding.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids)] += 1
        assert got == want
    assert bpe.encode_documents(edge_docs(spark).limit(0), RANKS).count() == 0


def test_long_texts_are_cut_where_it_is_safe():
    codec = bpe.Codec.of(RANKS)
    for text in ("it's  a\n\n test 12 ab.c " * 40, "x" * 500, " " * 300, "ab   cd　ef " * 50):
        assert codec.encode(text, long=20) == codec.encoding.encode_ordinary(text)
        assert "".join(bpe.pieces(text, 20)) == text


# 4: SimHash


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower((text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("source", [edge_docs, documents])
def test_near_duplicates_match_brute_force(spark, source):
    docs = source(spark)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    roots = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3])
    least = defaultdict(list)
    for (doc, _), root in zip(rows, roots, strict=True):
        least[root] += [doc] if doc is not None else []
    want = Counter((doc, f, min(least[root], default=None)) for (doc, f), root in zip(rows, roots, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


def test_golay_keys_meet_every_link():
    random = np.random.default_rng(1)
    a = random.integers(0, 2**64, 2000, dtype=np.uint64)
    flips = [reduce(lambda x, k: x | 1 << int(k), random.choice(64, random.integers(0, 4), replace=False), 0) for _ in a]
    rows, keys = simhash.fuzzy_keys(np.concatenate([a, a ^ np.array(flips, np.uint64)]))
    found = defaultdict(set)
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        found[r].add(k)
    assert all(found[i] & found[i + 2000] for i in range(2000))


def test_large_groups_keep_their_links():
    random = np.random.default_rng(4)
    fp = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << random.integers(0, 64, 5000).astype(np.uint64)) ^ (random.integers(0, 2, 5000).astype(np.uint64) << np.uint64(7))
    i, j = simhash.group_links(fp)
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 3).all() and len(i) < 4 * len(fp)
    assert len(set(union_find(len(fp), zip(i.tolist(), j.tolist(), strict=True)))) == 1


def test_one_document_of_each_group_stays(spark):
    kept = simhash.one_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert [r.doc_id for r in kept.where("doc_id in (1, 2, 3)").collect()] == [1]
    assert simhash.one_of_each(edge_docs(spark).limit(0)).count() == 0


# 5: lines


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    y = np.array(list(b), dtype="U1")
    for i, c in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        # what comes from the left costs one for each step
        new = np.concatenate([[i], new]) - np.arange(len(b) + 1)
        row = np.minimum.accumulate(new) + np.arange(len(b) + 1)
    return int(row[-1])


def similar_pairs(keys):
    """All pairs of edit similarity 0.8 or more. Only pairs whose letters and pairs of letters alone need more edits are left out."""
    length = np.array([len(k) for k in keys])
    names = {}
    counts = [np.zeros((len(keys), 4096), np.int16) for _ in range(2)]
    for i, k in enumerate(keys):
        for n, count in enumerate(counts):
            for j in range(len(k) - n):
                count[i, names.setdefault(k[j : j + n + 1], len(names)) % 4096] += 1
    # in few columns first, so that most pairs need no more
    few = [c.reshape(len(keys), 64, 64).sum(axis=1, dtype=np.int16) for c in counts]
    found = []
    for i in range(len(keys)):
        others = np.arange(i + 1, len(keys))
        most = 0.2 * np.maximum(length[others], length[i]) + 1e-9
        near = np.abs(length[others] - length[i]) <= most
        for table in (few, counts):
            for n, count in enumerate(table):
                others, most = others[near], most[near]
                more = count[others] - count[i]
                near = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= (n + 1) * most
        found += [(i, j) for j, m in zip(others[near].tolist(), most[near].tolist(), strict=True) if lines.edit_distance_within(keys[i], keys[j], int(m))]
    return found


def brute_lines(rows):
    """(kept text, lines removed) of each row; no two rows are equal."""
    classes = defaultdict(list)
    for doc, text in rows:
        for place, line in enumerate((text or "").split("\n")):
            if text is not None and (w := re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(line.encode()))):
                classes[b" ".join(w).decode()].append((doc, place))
    keys = list(classes)
    links = similar_pairs(keys)
    groups = defaultdict(list)
    for k, root in zip(keys, union_find(len(keys), links), strict=True):
        groups[root] += classes[k]
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    return {doc: (None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (doc, p) not in gone), sum(d == doc for d, _ in gone)) for doc, text in rows}


def test_lines_match_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again and again today"
    own = [(1, f"{base}\nshort line\n{base}\n..."), (2, base.replace("lazy", "lazyy") + "\nshort line\n..."), (3, "\n\n" + base.upper() + "!\n"), (4, None), (5, ""), (6, "Short: line")]
    for docs in (spark.createDataFrame([(*r, 1, "x") for r in own], "doc_id long, text string, id int, gone string"), documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = lines.without_lines(docs, count_as="lost")
        assert got.columns == [*docs.columns, "lost"]
        assert {r.doc_id: (r.text, r.lost) for r in got.collect()} == brute_lines(rows)


def test_altered_lines_are_found(spark):
    random = np.random.default_rng(3)
    word = ["".join(random.choice(list("abcdefghij"), random.integers(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(600):
        line = [str(w) for w in random.choice(word, random.integers(8, 70))]
        other = line.copy()
        for k in random.choice(len(line), 1 + len(line) // 20, replace=False):
            other[k] = str(random.choice(word))
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.text for r in lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] for i in range(600))
    assert sum(got[2 * i + 1] == "" for i in range(600)) >= 0.98 * 600


def test_large_groups_of_lines_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lines, "TOGETHER", 4)
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{text} number {i}") for i in range(60)]
    got = [r.doc_id for r in lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text <> ''").collect()]
    assert got == [0]


def test_one_of_equal_rows_keeps_its_lines(spark):
    rows = [(1, "a line of words\n\nother words"), (1, "a line of words\n\nother words"), (2, "A line of words!"), (3, None), (3, None)]
    got = Counter((r.doc_id, r.text, r.n) for r in lines.without_lines(spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, m map<string,int>"), count_as="n").collect())
    assert got == Counter([(1, "a line of words\n\nother words", 0), (1, "", 2), (2, "", 1), (3, None, 0), (3, None, 0)])


def test_lines_of_edge_cases(spark):
    got = lines.without_lines(edge_docs(spark))
    assert got.columns == edge_docs(spark).columns and got.count() == len(EDGE)
    assert [r.text for r in got.where("doc_id is null and text is not null").collect()] == ["twice the same words in this line"]
    assert [r.text for r in got.where("doc_id in (6, 7)").collect()] == [""] * 3
    assert lines.without_lines(edge_docs(spark).limit(0)).count() == 0


def test_bounded_edit_distance():
    random = np.random.default_rng(5)
    for _ in range(300):
        a, b = ("".join(random.choice(list("abcd "), random.integers(0, 90))) for _ in range(2))
        b = a[: len(a) // 2] + b[: random.integers(0, 20)] + a[len(a) // 2 + 2 :]
        d = edit_distance(a, b)
        assert lines.edit_distance_within(a, b, d) and not lines.edit_distance_within(a, b, d - 1)


def test_edit_similarity_of_long_lines():
    a = "".join(chr(97 + i * 7919 % 26) for i in range(20_000))
    assert lines.edit_similar(a, "q" + a[:9000] + a[9100:] + "z")
    assert not lines.edit_similar(a[:400], a[200:400] + "?" * 200)


# 7: chat


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<<s>>", "[/ROLE][ROLE]", "", "é\n", "[/INST"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(1, 3, "assistant", "again"), (2, None, None, None), (None, 0, "assistant", "x"), (2, 1, "a[ROLE]b", LONG)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, RANKS), RANKS).collect()}
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        chats[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == len("<s>") + sum(len(f"[ROLE]{chat.escape(r)}[/ROLE]{chat.escape(t)}</s>") for _, _, r, t in turns)
    assert chat.read_back(chat.format_chats(df.limit(0), RANKS), RANKS).count() == 0


def test_places_and_first_tokens(spark):
    df = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(5)], "conv_id long, turn long, role string, text string")
    at = 0
    for i, r in enumerate(chat.format_chats(df, RANKS).orderBy("place").collect()):
        assert (r.place, r.first_token) == (i, at)
        at += len(r.ids)


def test_escaped_texts_hold_no_control_string():
    for text in ("<s", "<<s>>", "</s></s>", "[INST][/INST]", "\\<s>", "<\\s>"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


# 9: decontamination


def test_leaks_match_a_plain_search(spark):
    docs, benchmark = documents(spark), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = {r.item_id: decontaminate.words_of(r.text) for r in benchmark.collect()}
    want = set()
    for r in docs.collect():
        w = decontaminate.words_of(r.text or "")
        for i, x in items.items():
            if any(w[k : k + len(x)] == x for k in range(len(w) - len(x) + 1)):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert want and want <= got and len(got - want) <= 2
    clean = decontaminate.without_leaks(docs, benchmark)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {d for d, _ in got}


def test_search_gives_all_above_the_threshold():
    random = np.random.default_rng(6)
    word = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choice(word, random.integers(3, 12)))) for i in range(50)]
    index = decontaminate.Index(items, 0.4)
    texts = [" ".join(random.choice(word, n)) for n in (0, 1, 5, 40, 200)]
    hashes = [np.array([hash_bytes(w) for w in decontaminate.words_of(t)], np.uint64) for t in texts]
    first = np.cumsum([0, *map(len, hashes)])
    everything = np.concatenate(hashes)
    got = {(a, b, i): s for _, a, b, i, s in index.search(everything, first)}
    own = [sum(index.impact[index.first[n] : index.first[n + 1]][index.item[index.first[n] : index.first[n + 1]] == i].sum() for n in range(len(index.hashes))) for i in range(len(index.item_ids))]
    assert np.allclose(own, 1)
    step = index.longest
    want = {}
    for a, b in zip(first[:-1], first[1:], strict=True):
        starts = range(a, max(a + 1, b - step), step) if b > a else []
        for s in starts:
            e = min(s + 2 * step, b)
            score = np.zeros(len(index.item_ids))
            for n in set(index.numbers(everything[s:e]).tolist()) - {-1}:
                score[index.item[index.first[n] : index.first[n + 1]]] += index.impact[index.first[n] : index.first[n + 1]]
            want |= {(int(s), int(e), i): x for i, x in enumerate(score) if x >= 0.4 - 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_of_edge_cases(spark):
    benchmark = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "One question here? Yes.", 1), (4, "One question here? Yes.", 1), (5, "tiny", 1)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, "so: one QUESTION here? yes. more", 1), (2, None, 1), (2, "", 1), (None, "one question here yes", 1), (3, "Tiny", 1)], "doc_id long, text string, item_id int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect())
    assert got == [(False, 0, 3), (False, 0, 4), (True, 1, 3), (True, 1, 4), (True, 3, 5)]
    assert decontaminate.without_leaks(docs, benchmark).columns == docs.columns
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == 5
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


# 10: licences


def test_licences_match_brute_force(spark):
    own = [(1, "The MIT License, the mit-license! Released under the MIT License."), (2, "under the Apache License; GNU General Public License v3"), (3, " ".join(licenses.TEMPLATES["bsd"].split()[4:]) + " mit"), (4, "mit"), (5, None), (6, ""), (None, "mit license")]
    for docs in (spark.createDataFrame([(*r, 1, "x") for r in own], "doc_id long, text string, labels int, spans string"), documents(spark)):
        got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()]
        want = []
        for r in docs.collect():
            w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((r.text or "").encode()))
            at, found = [], set()
            for phrase, label in licenses.PHRASES.items():
                p = phrase.encode().split()
                here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
                at, found = at + here, found | ({label} if here else set())
            want.append((r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))))
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_licences_chain_long_matches(spark):
    words = licenses.TEMPLATES["mit-full"].split()
    words[20] = "altered"
    docs = spark.createDataFrame([(1, "Intro. " + " ".join(words) + " outro"), (2, " ".join(words[:10]))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert "mit-full" in got[1].labels.split(",") and 0.9 < got[1].score < 1
    assert (got[1].spans[0].first_word, got[1].spans[0].last_word) == (1, len(words))
    assert got[2].labels == "" and got[2].score == 0


def test_whole_licences_are_found(spark):
    texts = licenses.full_texts()
    assert len(texts) >= 10
    gpl, half = texts["gpl-3-text"], texts["apache-2.0-text"]
    docs = spark.createDataFrame([(1, f"before\n{gpl}\nafter"), (2, half[: len(half) // 2]), (3, half.replace("Licensor", "Giver"))], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(docs, templates=licenses.TEMPLATES | texts).collect()}
    assert "gpl-3-text" in got[1] and "apache-2.0-text" not in got[2] and "apache-2.0-text" in got[3]


def test_automaton_gives_matching_statistics():
    random = np.random.default_rng(8)
    templates = [random.integers(0, 3, 12).tolist() for _ in range(4)]
    automaton = licenses.Automaton(templates)
    text = random.integers(0, 4, 300).tolist()
    parts = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (_, length) in enumerate(automaton.statistics(text)):
        assert length == max((n for n in range(13) if n <= i + 1 and (n == 0 or tuple(text[i + 1 - n : i + 1]) in parts)), default=0)


# the pipeline


def test_pipeline_matches_its_stages_by_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = documents(spark)
    model = quality.Model.unpacked(quality.fit_quality(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))).collect()}
    assert model.a > 0
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] >= 0.3]
    kept = brute_lines(rows)
    fps = [(d, brute_fingerprint(kept[d][0])) for d, _ in rows]
    roots = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i][1] ^ fps[j][1]).bit_count() <= 3])
    least = {}
    for (d, _), root in zip(fps, roots, strict=True):
        least[root] = min(least.get(root, d), d)
    left = sorted(least.values())
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]

    def leaks(text):
        w = decontaminate.words_of(text)
        return any(w[k : k + len(x)] == x for x in items for k in range(len(w) - len(x) + 1))

    want = {d: bpe.Codec.of(RANKS).encoding.encode_ordinary(kept[d][0]) for d in left if not leaks(kept[d][0])}
    assert {r.doc_id: r.ids for r in pipeline.run(spark, SF_DIR).collect()} == want


def test_stages_keep_columns(spark):
    import corpus_pipeline as pipeline

    docs = edge_docs(spark)
    assert [k for k, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
