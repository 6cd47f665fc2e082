"""Plain versions of the operators on conversations and of the language model, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def damaged(rows: list[tuple]) -> dict:
    """Rows ``(conv_id, turn, role, text)`` after damage, in order, by conversation."""
    out: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        at = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        at += [(turn, role, text)] * (2 if kind == 3 else 1)
    for at in out.values():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
    return out


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, role, text in rows:
        inside = BLANK.findall(text)
        if not inside:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if inside[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple], bad: list[str]) -> tuple[int, str, list[str]]:
    """Least cost, least audit, repaired lines; every edit tried at every place, from the last row to the first."""
    wanted = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(after: dict) -> dict:
        """What follows a last role, with up to three turns inserted first."""
        for _ in range(3):
            tried = {last: [(after[r[0]][0] + 5, "I" + after[r[0]][1], (f"{r}:", after[r[0]][2])) for r in ("user", "assistant") if r[0] in wanted[last] and r[0] in after] for last in wanted}
            after = {last: min([*found, *([after[last]] if last in after else [])], key=lambda x: x[:2]) for last, found in tried.items() if found or last in after}
        return after

    best = inserted({last: (0, "", None) for last in ("", "a")})
    for (_, role, text), fault in zip(rows[::-1], bad[::-1], strict=True):
        here = {}
        for last in wanted:
            found = [(best[last][0] + 2, "D" + best[last][1], best[last][2])] if last in best else []
            if fault in ("ok", "truncated"):
                more = 5 if fault == "truncated" else 0
                choices = [(0, "K", role)] * bool(role) + [(1, "R", r) for r in ("user", "assistant")]
                found += [(best[r[0]][0] + cost + more, edit + best[r[0]][1], (f"{r}:{text}", best[r[0]][2])) for cost, edit, r in choices if r[0] in wanted[last] and r[0] in best]
            if found:
                here[last] = min(found, key=lambda x: x[:2])
        best = inserted(here)
    cost, audit, rest = best[""]
    lines = []
    while rest:
        lines.append(rest[0])
        rest = rest[1]
    return cost, audit, lines


def repairs(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, at in damaged(rows).items():
        bad = faults(at)
        turns = {t for t, _, _ in at if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(at, at[1:]))
        cost, audit, lines = cheapest(at, bad)
        count = Counter(bad)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha))
    return out


def regrouped(rows: list[tuple]) -> dict[int, list[tuple]]:
    """Conversations ``(role, text)`` in order, with the first turns of the one that heads their group."""
    plain = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            plain[conv].append((turn, role or "", text or ""))
    for at in plain.values():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
    out = {}
    for conv, at in plain.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = [r[1:] for r in plain.get(conv - conv % 20, [])[:h]] + [r[1:] for r in at[h:]]
    return out


def trie(conversations: dict[int, list[tuple]]) -> list[tuple]:
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, at in members.items():
        spare = (len(at) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += spare
    return [
        (
            min(at), len(node), min(members[node[:-1]]) if node else None, len(at), kids[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, at in members.items()
    ]


def lower_words(text: str | None) -> list[str]:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def discounts(n: list[int]) -> list[float]:
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    out = [(k + 1 - (k + 2) * y * n[k + 1] / n[k]) if n[k] else 0.0 for k in range(3)]
    return [0.0] + [d if 0 < d <= k + 1 else 0.5 for k, d in enumerate(out)]


def language_model(texts: list[str | None]) -> tuple:
    """Token counts and the probability function of the model."""
    ones, twos = Counter(), Counter()
    for text in texts:
        words = [*lower_words(text), None]
        ones.update(words)
        twos.update(zip([0, *words], words))
    before, context, spread = Counter(), Counter(), defaultdict(Counter)
    for (v, w), c in twos.items():
        before[w] += 1
        context[v] += c
        spread[v][min(c, 3)] += 1
    levels = [discounts([sum(c == k for c in counts.values()) for k in range(1, 5)]) for counts in (twos, before)]

    free = sum(levels[1][min(c, 3)] for c in before.values()) / max(1, len(twos))

    def alone(w) -> float:
        if not twos:
            return 1.0
        return (before[w] - levels[1][min(before[w], 3)]) / len(twos) + free / (len(ones) + 1)

    memo: dict = {}

    def p(w, v) -> float:
        if w not in memo:
            memo[w] = alone(w)
        if not context[v]:
            return memo[w]
        c = twos[v, w]
        gamma = sum(levels[0][k] * n for k, n in spread[v].items()) / context[v]
        return (c - levels[0][min(c, 3)]) / context[v] + gamma * memo[w]

    return ones, p


def scores(rows: list[tuple]) -> list[tuple]:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of rows ``(doc_id, text)``."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    ones, p = language_model([t for (_, t), h in zip(rows, held) if not h])
    total, out = sum(ones.values()), []
    for (i, text), h in zip(rows, held):
        words = [*lower_words(text), None]
        base = math.fsum(math.log10((ones[w] + 1) / (total + len(ones) + 1)) for w in words)
        own = math.fsum(math.log10(p(w, v)) for v, w in zip([0, *words], words))
        out.append((i, h, len(words), sum(ones[w] > 0 for w in words), total, base, own))
    return out


def triple_model(texts: list[str | None]):
    """The probability of a token after the two before it (0: the start; None for what is before the start)."""
    ones, _ = language_model(texts)
    twos, threes = Counter(), Counter()
    for text in texts:
        words = [0, *lower_words(text), None]
        twos.update(zip(words, words[1:]))
        threes.update(zip(words, words[1:], words[2:]))
    before = Counter(w for _, w in twos)
    adjusted = Counter((v, w) for _, v, w in threes) + Counter({pair: c for pair, c in twos.items() if pair[0] == 0})
    spread, total = defaultdict(Counter), Counter()
    for counts in (adjusted, threes):
        for gram, c in counts.items():
            spread[gram[:-1]][min(c, 3)] += 1
            total[gram[:-1]] += c
    levels = [discounts([sum(c == k for c in counts.values()) for k in range(1, 5)]) for counts in (before, adjusted, threes)]
    free = sum(levels[0][min(c, 3)] for c in before.values()) / max(1, len(twos))

    def p(u, v, w) -> float:
        out = (before[w] - levels[0][min(before[w], 3)]) / len(twos) + free / (len(ones) + 1) if twos else 1.0
        for context, counts, cut in (((v,), adjusted, levels[1]), ((u, v), threes, levels[2])):
            if total[context]:
                c = counts[*context, w]
                out = (c - cut[min(c, 3)] + sum(cut[k] * n for k, n in spread[context].items()) * out) / total[context]
        return out

    return p


def triple_scores(rows: list[tuple]) -> list[tuple]:
    """``doc_id, n_tokens, triple_score`` of rows ``(doc_id, text)``."""
    p = triple_model([t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2])
    out = []
    for i, text in rows:
        words = [None, 0, *lower_words(text), None]
        out.append((i, len(words) - 2, math.fsum(math.log10(p(*g)) for g in zip(words, words[1:], words[2:]))))
    return out
