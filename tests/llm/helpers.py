from __future__ import annotations

import math
import random
import re

from folioflow.llm import fertility

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def docs_of(spark, rows):
    """(doc_id, text, lang, source, n_chars) with defaults for what rows leave out."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")


EDGES = [(None, "lost id"), (7090, None), (7091, ""), (7092, "  \n"), (7093, "é"), (7093, "é"), (7094, "x " * 60000)]


FILES = fertility.read_vocabularies()


def brute_reasons(rows: list[tuple]) -> dict:
    """Why each (key, text, language) is rejected, by a plain computation over distinct texts; keys are unique."""
    measured = dict(zip((r[0] for r in rows), zip(*fertility.measure([r[1] for r in rows], FILES))))
    step = lambda x: round(x / fertility.STEP)
    median = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    octave = lambda m: int(math.log2(max(1, m[0])))
    distinct = {(r[2], r[1]): measured[r[0]] for r in rows if measured[r[0]][0] >= fertility.MIN_TOKENS}

    def limits(texts, k):
        values = [step(m[1 + k]) for m in texts]
        mid = median(values)
        half = max(fertility.WIDTH * median([abs(v - mid) for v in values]), list(fertility.FLOOR.values())[k] / fertility.STEP)
        return mid - half, mid + half

    out = {}
    for key, _, lang in rows:
        m, every = measured[key], [x for (g, _), x in distinct.items() if g == lang]
        near = [x for x in every if octave(x) == octave(m)]
        texts = near if len(near) >= fertility.MIN_GROUP else every
        inside = [limits(texts, k) if texts else (-math.inf, math.inf) for k in range(3)]
        top = inside[1][1] if texts else -math.inf
        long = m[0] >= fertility.MIN_TOKENS
        out[key] = "empty" if m[0] == 0 else "byte_share" if step(m[2]) > max(top, fertility.FLOOR["byte_share"] / fertility.STEP) else "chars_per_token" if long and not inside[0][0] <= step(m[1]) <= inside[0][1] else "token_entropy" if long and step(m[3]) < inside[2][0] else None
    return out


def brute_groups(signatures: list[tuple], distance: int) -> dict:
    """id -> least id of its group, for all ids with a partner, by all pairs of (id, signature)."""
    parent = {i: i for i, _ in signatures}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(signatures):
        for j, b in signatures[n + 1 :]:
            if (a != b).sum() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in signatures if root(i) != i}
