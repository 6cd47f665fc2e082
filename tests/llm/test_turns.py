"""Repair and trie of conversations, and the language model, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnokit.llm import hash_arrays, kneser_ney, turn_repair
from limnokit.llm.kneser_ney import discounts, held_out, score, score_documents, token_probabilities, tokens, train, unmix
from limnokit.llm.prefix_trie import prefix_trie, regrouped, turn_rows
from limnokit.llm.radix import Node, insert
from limnokit.llm.turn_repair import Costs, damaged, evaluate, re_pair, repair_conversations
from limnokit.llm.words import mix

from . import brute_turns as brute
from .conftest import CLASHING, ordered

SCHEMA = "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"{c} string" for c in (*CLASHING, "kind", "copies", "slice", "node", "place"))
ROLES = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User", "unknown", "administrator"]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "done. ", "a\x0b.\x0c", "é", "Yes.", "Sure thing, here it is."]


def talk() -> list[tuple]:
    """Conversations with nulls, ties, repeated rows and roles of every kind."""
    r = random.Random(11)
    rows = [(conv, r.choice([turn, turn, turn, turn + 1, None]), r.choice(ROLES), r.choice(TEXTS)) for conv in range(70) for turn in range(r.randrange(1, 8))]
    rows += [(conv, turn, ROLES[1 + turn % 2], f"Turn {turn} of it.") for conv in (80, 81, 82, 84, 99, 101, 120) for turn in range(8)]
    rows += [(83, turn, ROLES[1 + turn % 2], f"Turn {turn} of it.") for turn in range(3)] + [(200, 0, "system", "Only this."), (201, 0, "user", "x")]
    rows += [(300, 1, "user", "Same again.")] * 40 + [(300, None, "user", "Same again.")] * 3 + [(301, 5, "assistant", "")] * 9
    rows += [(None, 1, "user", "No id."), (None, None, None, None), (-45, 3, "user", "Below zero."), (-40, 0, "user", "Head.")]
    rows += [(400, turn, "user" if turn % 3 else "assistant", "word " * (turn % 5) + ".") for turn in range(150)]
    return rows


@pytest.fixture(scope="module")
def talks():
    return talk()


@pytest.fixture(scope="module")
def conversations(spark, talks):
    return spark.createDataFrame([(*r, *["x"] * 19) for r in talks], SCHEMA).repartition(5)


def test_symbols_in_rules_spell_the_sequences():
    r = random.Random(5)
    sequences = [bytes(r.choice(b"ABCEFIJ") for _ in range(r.randrange(0, 40))) for _ in range(200)] + [b"A" * 33, b"", b"AB" * 50]
    rules, reduced = re_pair(sequences)

    def spell(symbol: int) -> bytes:
        return bytes([65 + symbol]) if symbol < 16 else spell(rules[symbol - 16][0]) + spell(rules[symbol - 16][1])

    assert [b"".join(map(spell, s)) for s in reduced] == sequences
    pairs = [p for s in reduced for p in zip(s, s[1:])]
    assert len(rules) == len(set(rules)) and sum(map(len, reduced)) < 0.7 * sum(map(len, sequences))
    assert all(p not in rules for p in pairs)


def test_matrices_of_parts_give_the_matrix_of_the_whole():
    r = random.Random(6)
    for _ in range(60):
        whole = bytes(r.choice(b"ABCDEFGHIJKLMNOP") for _ in range(r.randrange(2, 30)))
        cut = r.randrange(1, len(whole))
        (a, _), (b, _), (ab, tally) = evaluate([whole[:cut], whole[cut:], whole], [False] * 3, Costs())
        joined = turn_repair.product(a, b)
        assert [e and (e[0], e[1].text()) for e in joined] == [e and (e[0], e[1].text()) for e in ab]
        assert tally.blank == sum(s % 4 == 2 for s in whole)


def test_cheap_insertions_are_found():
    """With insertions at 1 they beat deletions; every state pair agrees with trying all edits."""
    costs = Costs(insert=1, delete=7, rerole=6)
    (matrix, _), = evaluate([b"EEII"], [False], costs)  # two user, two assistant turns
    closing = turn_repair.product(matrix, turn_repair.insertions(costs))
    assert (closing[0 * 4 + 3][0], closing[0 * 4 + 3][1].text()) == (2, "KIKKIK")


@pytest.mark.parametrize("run", [turn_repair.RUN, 4])
def test_repairs(spark, conversations, talks, run):
    got = repair_conversations(damaged(conversations), run=run)
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute.repairs(talks))


def test_repairs_of_nothing(spark, conversations):
    assert repair_conversations(damaged(conversations.limit(0))).count() == 0


def test_a_conversation_of_many_rows_is_many_runs(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)] + [(7, 1, "assistant", "Turn 1.")] * 500 + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    light = turn_repair._light_rows(damaged(df))
    pieces, _ = turn_repair._runs(light, 64)
    lengths = [r[0] for r in pieces.filter("conv_id = 7").select(F.length("symbols")).collect()]
    assert len(lengths) > 40 and max(lengths) <= 64
    got = {r["conv_id"]: r for r in repair_conversations(damaged(df), run=64).collect()}
    want = {r[0]: r for r in brute.repairs(rows)}
    assert {k: (r["cost"], r["audit"], r["repaired_sha256"]) for k, r in got.items()} == {k: (r[6], r[7], r[8]) for k, r in want.items()}


def test_radix_tree_finds_its_keys_in_order():
    r = random.Random(3)
    keys = sorted({bytes(r.choice([0, 1, 2, r.randrange(256)]) for _ in range(r.randrange(0, 6))) for _ in range(3000)})
    root = None
    for number, key in enumerate(keys):
        root = insert(root, key, number)
    sizes, found = set(), []

    def walk(node: Node, path: bytes) -> tuple[int, int]:
        path += node.prefix
        sizes.add(node.size)
        seen = [node.end] if node.end >= 0 else []
        if node.end >= 0:
            found.append((path, node.end))
        for byte, kid in node.children():
            assert node.child(byte) is kid
            seen += walk(kid, path + bytes([byte]))
        assert (node.low, node.high) == (min(seen), max(seen))
        return node.low, node.high

    walk(root, b"")
    assert found == [(k, i) for i, k in enumerate(keys)] and sizes == {4, 16, 48, 256}
    assert root.child(7) is None or root.child(7).low > 0


@pytest.mark.parametrize("shape", [{}, {"length": 3, "most": 4}])
def test_trie(spark, conversations, talks, shape):
    turns = turn_rows(conversations)
    got = prefix_trie(regrouped(turns), **shape)
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute.trie(brute.regrouped(talks)))


def test_trie_of_copies_and_of_nothing(spark, conversations):
    rows = [(c, t, "user", f"Turn {t} here.") for c in range(60) for t in range(5)] + [(c, 5, "user", f"own {c}") for c in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie(regrouped(turn_rows(df)), length=2, most=3).collect()
    assert ordered(map(tuple, got)) == ordered(brute.trie(brute.regrouped(rows)))
    assert prefix_trie(regrouped(turn_rows(conversations.limit(0)))).count() == 0


def test_counted_keys_travel_packed():
    r = np.random.default_rng(1)
    for top in (1 << 10, 1 << 40, 1 << 63):
        keys = np.unique(r.integers(0, top, 500, dtype=np.uint64))
        width, packed = hash_arrays._pack(keys)
        assert (hash_arrays._unpack(width, len(keys), packed) == keys).all() and width <= 8
    x = r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    assert (unmix(mix(x)) == x).all()


def test_scores(spark, docs, no_docs, rows):
    got = [tuple(r)[:7] for r in score_documents(docs).collect()]
    want = brute.scores(rows)
    assert ordered(r[:5] for r in got) == ordered(r[:5] for r in want)
    for at in (5, 6):
        assert sorted(r[at] for r in got) == pytest.approx(sorted(r[at] for r in want), abs=1e-7)
    assert score_documents(no_docs).count() == 0
    untrained = [tuple(r) for r in score(docs.select("doc_id", "text"), train(no_docs)).collect()]
    assert {r[5:7] for r in untrained} == {(0.0, 0.0)} and {r[3:5] for r in untrained} == {(0, 0)}


def test_small_shards_and_blocks_give_the_same(spark, docs, monkeypatch):
    want = ordered(map(tuple, score_documents(docs).collect()))
    monkeypatch.setattr(kneser_ney, "WORDS_A_SHARD", 1 << 12)
    monkeypatch.setattr(kneser_ney, "PAIRS_A_SHARD", 1 << 10)
    got = ordered(map(tuple, score_documents(docs).collect()))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["a b a c a b d", "b a b", "c", "", "a a a a e f g a b"]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = sorted({w for t in texts for w in t.split()})
    for context in ("", "a ", "b ", "never seen "):
        # The end follows a context too; an unknown word stands for all others
        follow = pa.array([f"{context}{w}" for w in (*words, "unheard")] + [context.strip()])
        hashes, starts = tokens(follow)
        _, p = token_probabilities(model, hashes, starts)
        own = p[starts[1:] - 2][:-1] if context else p[starts[:-1]][:-1]
        assert own.sum() + p[starts[-1] - 1] == pytest.approx(1.0, abs=1e-12)


def test_discounts_where_counts_do_not_tell():
    assert discounts(0, 0, 0, 0) == (0.5, 0.5, 0.5)
    y = 10 / (10 + 2 * 5)
    assert discounts(10, 5, 2, 1) == pytest.approx((1 - 2 * y * 0.5, 2 - 3 * y * 0.4, 3 - 4 * y * 0.5))


def test_the_model_knows_language(spark):
    """Held-out texts of a chain of words score better than by single words, and than when shuffled."""
    r = random.Random(8)
    step = {w: [r.randrange(300) for _ in range(3)] for w in range(300)}

    def text() -> list[str]:
        out = [r.randrange(300)]
        while len(out) < 60:
            out.append(r.choice(step[out[-1]]))
        return [f"w{w}" for w in out]

    data = []
    for i in range(800):
        words = text()
        data.append((i, " ".join(words)))
        data.append((i + 10_000, " ".join(r.sample(words, len(words))))) if i % 7 == 2 else None
    docs = spark.createDataFrame(data, "doc_id long, text string")
    straight = docs.filter("doc_id < 10000")
    model = train(straight.filter(~held_out()))
    total = lambda df: df.filter(held_out()).transform(lambda d: score(d, model)).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    own, base = total(straight)
    assert own > base + 0.8
    assert own > total(docs.filter("doc_id >= 10000"))[0] + 0.8
