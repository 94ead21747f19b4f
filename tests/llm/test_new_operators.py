"""Turn repair, URL rules and token alignment against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from panelrisk.llm import (simhash_groups, token_align, token_counts, toxicity, turn_repair,
                           url_rules)
from panelrisk.llm.workload import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


# --- 11 conversation structure ---------------------------------------------------------------

def damaged(rows):
    out, ids = collections.defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(out[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c in ids}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        black = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not black else "duplicate" if (role, text) in seen
                 else "truncated" if black[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """All edit strings that stay within the best cost, by plain recursion from the end."""
    best: dict = {}

    def least(i, state, inserts):
        """(cost, string, turns) from row i in this state, with at most ``inserts`` inserts here."""
        if (i, state, inserts) in best:
            return best[i, state, inserts]
        found = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", state):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, turns = least(i + 1, state, 2)
            found.append((cost + 2, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for letter, name, own in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name and re.fullmatch("s?(ua)*u?", state + name[0]):
                        cost, audit, turns = least(i + 1, small(state + name[0]), 2)
                        found.append((cost + own + more, letter + audit, ((name, text), *turns)))
        if inserts:
            for name in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", state + name[0]):
                    cost, audit, turns = least(i, small(state + name[0]), inserts - 1)
                    found.append((cost + 5, "I" + audit, ((name, ""), *turns)))
        best[i, state, inserts] = min(found) if found else (10 ** 9, "", ())
        return best[i, state, inserts]

    def small(state):
        return re.sub("(ua)+(ua)", "ua", state)

    return least(0, "", 2)


def expected(rows):
    out = []
    for conv, own in damaged(rows).items():
        faults = faults_of(own)
        given = [t for t, _, _ in own if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in itertools.pairwise(own))
        cost, audit, turns = cheapest(own, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns))))
    return out


def conversations(seed=5, n=150):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(0, 9)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 3, None]),
                         rnd.choice(["system", "user", "assistant", "user", "assistant", "tool",
                                     "", None, "sage"]),
                         rnd.choice(["yes.", "no", "", " \t", "a?", None, "why!\n", "é", "yes."])))
    rows += [(None, 1, "user", "lost."), (None, None, "assistant", "found."), (700, None, None, None)]
    rows += [(800, 1, "user", "same."), (800, 1, "user", "same."), (800, 1, "assistant", "same.")]
    rows += [(900 + i, 0, "user", "alone.") for i in range(60)]  # some are dropped whole
    rows += [(1000, i, "user" if i % 2 == 0 else "assistant", "long " * 20_000 + ".")
             for i in range(4)]
    return rows


def repaired(spark, rows):
    left, dropped = turn_repair.damage(spark.createDataFrame(
        [(*r, "x", 1) for r in rows], TURNS + ", fault string, conv int"))
    return left, turn_repair.repair(left, dropped)


def test_turn_repair(spark):
    rows = conversations()
    left, got = repaired(spark, rows)
    same(got.drop("turns").collect(), expected(rows))
    turns = collections.defaultdict(list)
    for r in turn_repair.repaired_turns(left, got).orderBy("conv_id", "place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {r.conv_id: r.repaired_sha256 for r in got.collect()} \
        == {r.conv_id: sha("\n".join(turns[r.conv_id])) for r in got.collect()}


def test_turn_repair_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op11_turn_repair"](spark, sf).collect(), expected(rows))


def test_turn_repair_of_nothing(spark):
    assert repaired(spark, [])[1].count() == 0


def test_turn_repair_carries_state_across_batches(spark):
    rows = conversations(8, 60) + [(5_000, i, "user" if i % 3 else "assistant", f"word {i}.")
                                   for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(repaired(spark, rows)[1].drop("turns").collect(), expected_long(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def expected_long(rows):
    import sys
    sys.setrecursionlimit(50_000)
    return expected(rows)


def test_backpointers_spill(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3), rnd.choice("sua") + "x", f"t{i}.") for i in range(500)]
    results = []
    for limit in (16, 100, 1 << 20):
        program = turn_repair.Program(limit)
        for fault, role, text in rows:
            program.add(fault, role, text)
        assert (program.pointers.file is not None) == (limit < 1 << 20)
        results.append(program.result())
    assert results[0] == results[1] == results[2]


def test_turn_repair_shuffles_texts_once(spark, sf):
    from tests.conftest import plan_of

    left, _ = turn_repair.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert plan_of(turn_repair.repair(left)).count("Exchange") == 1


# --- 12 URL rules ----------------------------------------------------------------------------

def judged(urls, rules, otherwise="allow"):
    out = []
    for page, url in urls:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = found.groups() if found else ("", "")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = []
        for rhost, rpath, verdict in rules:
            rhost = "".join(c.lower() if c.isascii() else c for c in rhost or "")
            rpath = rpath or ""
            if rhost and verdict in ("allow", "block") and path.startswith(rpath) \
                    and (host == rhost or host.endswith("." + rhost)):
                fit.append((len(rhost + rpath), len(rhost), verdict, rhost + rpath))
        best = max(fit) if fit else (0, 0, otherwise, None)
        out.append((page, host, path, best[3], best[2]))
    return out


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http:///x"), (6, "://net/a"),
        (7, "HTTP://Example.NET/EN/"), (8, "http://example.net"), (9, "http://example.net?q=/en/"),
        (10, "http://example.net#/en/"), (11, "http://sub.example.net/en/x?y#z"),
        (12, "http://myexample.com/de/1"), (13, "http://a..example.com/de/1"),
        (14, "http://.net/a"), (15, "http://net./a"), (16, "http://u@net:80/a"),
        (17, "http://x.net/a://b.org/fr/"), (18, "http://é.ÉX.org/fr/\U0010ffff"),
        (19, "http://a.net/\nb"), (20, "http://same.org/fr/"), (20, "http://same.org/fr/"),
        (None, "http://same.org/fr/"), (None, None), (None, None), (21, "http://org/fr/" + "x" * 90_000)]


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_url_rules(spark, slices):
    rnd = random.Random(slices)
    labels = ["a", "b", "net", "org", "A", ""]
    rules = [*url_rules.RULES, ("NET", None, "allow"), (None, "/", "block"), ("", "/", "block"),
             ("b", "/a", "perhaps"), ("b", "x", "block"), ("a.b", "", "block"), ("b", "/aa", "allow")]
    rules += [(".".join(rnd.choices(labels, k=rnd.randint(1, 3))),
               "/" + "/".join(rnd.choices("ab", k=rnd.randint(0, 3))),
               rnd.choice(["allow", "block"])) for _ in range(80)]
    urls = URLS + [(100 + i, "s://" + ".".join(rnd.choices(labels, k=rnd.randint(1, 5))) + "/"
                    + "/".join(rnd.choices("ab", k=rnd.randint(0, 4)))) for i in range(1500)]
    urls += [(5_000, "http://hot.net/a")] * 700
    pages = spark.createDataFrame([(p, u, "h", "k", 0) for p, u in urls],
                                  "page_id long, url string, host string, key string, slice int")
    got = url_rules.judge(pages, spark.createDataFrame(
        rules, "host string, path string, verdict string"), slices=slices)
    same(got.collect(), judged(urls, rules))


def test_url_rules_without_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    no_rules = spark.createDataFrame([], "host string, path string, verdict string")
    rules = spark.createDataFrame(url_rules.RULES, no_rules.schema)
    pages = spark.createDataFrame(URLS, none.schema)
    assert url_rules.judge(none, rules).count() == 0
    same(url_rules.judge(pages, no_rules, otherwise="block").collect(), judged(URLS, [], "block"))


def test_repeated_rows_come_back_in_steps(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "REPEATS", 4)
    rows = [(1, "http://x.net/")] * 9 + [(2, None)] * 8
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"),
                          spark.createDataFrame(url_rules.RULES,
                                                "host string, path string, verdict string"))
    same(got.collect(), judged(rows, url_rules.RULES))


# --- 13 token alignment ------------------------------------------------------------------------

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def tokens_of(tokenizers, text):
    """[(id, bytes)] of both tokenizers, or nothing where they do not give the bytes back."""
    a, b = tokenizers
    if not text:
        return [], []
    back = token_align.byte_level()
    left = [(i, bytes(back[c] for c in a.id_to_token(i)))
            for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    given = b" " + text.encode()
    if any(b"".join(x for _, x in side) != given for side in (left, right)):
        return [], []
    return left, right


def groups_of(left, right):
    def ends(side):
        return list(itertools.accumulate(len(x) for _, x in side))

    shared = sorted(set(ends(left)) & set(ends(right)))
    out = [([], []) for _ in shared]
    for k, side in enumerate((left, right)):
        for (i, _), end in zip(side, ends(side)):
            out[next(n for n, s in enumerate(shared) if end <= s)][k].append(i)
    return out


def aligned(tokenizers, rows):
    documents = []
    for doc, text in rows:
        left, right = tokens_of(tokenizers, text)
        groups = groups_of(left, right)
        documents.append((doc, left, right, groups,
                          [p for a, b in groups for p in itertools.product(a, b)]))
    held = collections.Counter(p for *_, links in documents for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for doc, left, right, groups, links in documents:
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, len(left), len(right), len(groups), len(links),
                    sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    sha(spelled) if left else ""))
    return out


PIECES = ["a", "b", " ", "  ", "'s", "\n", "\t", "é", "the", "<|endoftext|>", "\x00", "　", "ﬁ", "😀",
          "́", "1", "?!", "\x1c", "\r\n", "▁", "<s>", "<0x0A>", "word ", " word", "漢字", " é"]


def odd_texts(n=500):
    rnd = random.Random(13)
    rows = [(i, "".join(rnd.choices(PIECES, k=rnd.randint(0, 14)))) for i in range(n)]
    rows += [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "twice"), (4, "twice"),
             (5, "x" * 3_000), (6, "漢" * 400), (7, "many words " * 300)]
    return rows


def clashed(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "doc_id long, text string, row int, pairs string, n int")


def test_token_align(spark, sf, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .select("doc_id", "text").limit(40).collect() if len(r.text) < 3_000] + odd_texts()
    want = aligned(tokenizers, rows)
    same(token_align.digest(clashed(spark, rows), A_PATH, B_PATH).collect(), want)
    linked = token_align.pin(token_align.links(token_align.align(
        clashed(spark, rows), A_PATH, B_PATH)).withColumn(
            "row", token_align.F.monotonically_increasing_id()))
    for pairs in (0, 50):  # no pair, or a few, in the broadcast tier
        got = token_align.score_links(linked, pairs).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        same(got.collect(), want)


def test_token_align_of_nothing(spark):
    assert token_align.digest(clashed(spark, []), A_PATH, B_PATH).count() == 0
    got = token_align.digest(clashed(spark, [(1, ""), (2, None)]), A_PATH, B_PATH).collect()
    same(got, [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_wide_groups_pair_distinct_ids(monkeypatch):
    rnd = np.random.default_rng(3)
    in_a, in_b = rnd.integers(1, 9, 30), rnd.integers(1, 9, 30)
    a, b = rnd.integers(0, 4, in_a.sum()), rnd.integers(0, 4, in_b.sum())
    text = np.sort(rnd.integers(0, 5, 30))
    whole = token_align.pair_links(a, b, in_a, in_b, text)
    monkeypatch.setattr(token_align, "WIDE_LINKS", 6)
    for x, y in zip(whole, token_align.pair_links(a, b, in_a, in_b, text)):
        assert x.tolist() == y.tolist()


def test_full_cache_gives_the_same_ids(monkeypatch):
    own = token_align.Aligner(A_PATH, B_PATH)
    batches = [[f"word{i + k} again word{i} é" for k in range(40)] for i in range(0, 200, 9)]
    whole = [own.ids(b) for b in batches]
    monkeypatch.setattr(token_align, "CACHE_BYTES", 30_000)
    small = token_align.Aligner(A_PATH, B_PATH)
    assert [small.ids(b) for b in batches] == whole
    assert small.bytes <= 30_000


# --- 3 token counts: the broadcast tier ---------------------------------------------------------

def test_frequent_words_come_from_whole_texts(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"rare{i}x{k}" for k in range(40)], k=30)
                         + ["often"] * 6 + ["second"] * 3)) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " "), (403, "▁mark " * 5_000), (404, "y" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert token_counts.frequent_words(docs, size=2, summary=20) == ["often", "second"]
    assert token_counts.frequent_words(spark.createDataFrame([], docs.schema)) == []
    words = token_counts.thinned(collections.Counter("aaabbc"), 2)
    assert words == {"a": 2, "b": 1} and token_counts.thinned(words, 2) is words


# --- 4 toxicity: the query against plain Python -----------------------------------------------

def features_of(text):
    found = set()
    for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        found |= set(toxicity.word_features(word))
    return found


def auc_of(pairs):
    ones, zeros = ([s for s, y in pairs if y == k] for k in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
    return wins / (len(ones) * len(zeros))


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}

    # the features that the fit sees, chosen anew from the rows that may be learned from
    own = {i: y for i, y in toxic.items() if y in (0, 1) and not held[i]}
    n = collections.Counter(own.values())
    seen = {c: collections.Counter() for c in (0, 1)}
    for i, y in own.items():
        seen[y].update(features_of(docs[i]))
    strength = {}
    for f in seen[0].keys() | seen[1].keys():
        t, c = seen[1][f], seen[0][f]
        both = (t + c) / (n[0] + n[1])
        z = abs(t / n[1] - c / n[0]) / (both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12) ** 0.5
        if t + c >= toxicity.MIN_DOCS and z >= toxicity.MIN_Z:
            strength[f] = z
    weights, intercept = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"),
                                        spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(weights) == set(sorted(strength, key=lambda f: (-strength[f], f))
                               [:toxicity.MAX_FEATURES])

    got = QUERIES["op4_toxicity"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        total = intercept + sum(weights.get(f, 0.0) for f in features_of(docs[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.3)


def test_toxicity_on_held_out_rows_of_the_larger_tables(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    late = [(r.score, toxic[r.doc_id]) for r in QUERIES["op4_toxicity"](spark, sf).collect()
            if r.held_out and toxic.get(r.doc_id) in (0, 1)]
    assert auc_of(late) > 0.95


def test_toxicity_takes_long_texts_whole(spark):
    rows = [(i, "calm words " * 9 + ("vilest" if i % 3 == 0 else "")) for i in range(300)]
    long = [(1_000, "calm words " * 60_000 + "vilest"), (1_001, "calm words " * 60_000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(
        spark.createDataFrame(rows + long, "doc_id long, text string"), labels).collect()}
    assert got[1_000] == got[0] and got[1_001] == got[1] and got[0] > got[1]


def test_odd_numbers_of_bits_are_refused_at_every_size(spark):
    with pytest.raises(ValueError, match="even"):
        simhash_groups.simhash_groups(spark.createDataFrame([(1, "a b")], "doc_id long, text string"),
                                      k=3)
