"""Versions of the classifier and of the fingerprints written from their description alone, in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from freightcube.llm import queries
from freightcube.llm.quality import classify_quality

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mix(h):
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


# ------------------------------------------------------------------ quality

def plain_measures(text):
    data = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    is_plain = lambda w: any(chr(b).isalnum() or b > 127 for b in w)
    marks = b".,;:?'\"()-"
    n_words, pairs = len(words), list(zip(words, words[1:]))
    lower = sum(97 <= b <= 122 or b > 127 for b in data)
    upper, digits = sum(65 <= b <= 90 for b in data), sum(48 <= b <= 57 for b in data)
    signs = sum(1 for b in data if not (97 <= b <= 122 or b > 127 or 65 <= b <= 90 or 48 <= b <= 57 or b in b" \t\n\r\x0b\x0c" or b in marks))
    per_word = max(1, n_words)
    events = [sum(len(w) <= 3 for w in words), sum(not is_plain(w) for w in words), sum(w[-1:] in [bytes([m]) for m in marks] for w in words),
              sum(a == b for a, b in pairs), sum(w.endswith(b"!") for w in words), len(set(pairs))]
    letters = max(1, lower + upper)
    shares = {"signs": signs / max(1, len(data)), "upper": upper / letters, "shouts": events[4] / per_word, "bare": events[1] / per_word,
              "repeated": events[3] / per_word, "pairs": events[5] / max(1, n_words - 1), "variety": len(set(words)) / math.sqrt(per_word),
              "length": (lower + upper + digits) / per_word, "short": events[0] / per_word, "ended": events[2] / per_word,
              "plain": (lower + digits) / max(1, lower + digits + upper + signs)}
    return n_words, shares, [e / per_word for e in events]


#: (share, good up to or None, bad from) or, turned round, (share, good from, bad up to, True).
RULES = [("signs", None, 0.03), ("upper", None, 0.4), ("shouts", None, 0.3), ("bare", None, 0.2), ("repeated", None, 0.2), ("pairs", 0.75, 0.6, True),
         ("variety", 3.0, 1.5, True), ("length", 8.0, 12.0), ("short", 0.15, 0.05, True), ("ended", 0.04, 0.01, True), ("plain", 0.93, 0.85, True)]


def plain_votes(text):
    n_words, shares, _ = plain_measures(text)
    if n_words < 5:
        return (None,) * len(RULES)
    out = []
    for name, good, bad, *turned in RULES:
        x = shares[name]
        if good is not None and (x >= good if turned else x <= good):
            out.append(1)
        else:
            out.append(0 if (x <= bad if turned else x >= bad) else None)
    return tuple(out)


def plain_posteriors(patterns):
    """Expectation-maximisation, document by document."""
    heard = [p for p in patterns if any(v is not None for v in p)]
    belief = {p: (p.count(1) + 0.5) / (p.count(1) + 3 * p.count(0) + 1) for p in set(heard)}
    counts = Counter(heard)
    share = 0.5
    for _ in range(200):
        chances = []
        for i in range(len(RULES)):
            rows = []
            for c in (0, 1):
                seen = {0: 0.1, 1: 0.1, None: 0.1}
                for p, n in counts.items():
                    seen[p[i]] += n * (belief[p] if c else 1 - belief[p])
                total = sum(seen.values())
                rows.append({v: s / total for v, s in seen.items()})
            chances.append(rows)
        share = (sum(n * belief[p] for p, n in counts.items()) + 1) / (len(heard) + 2)
        for p in belief:
            good, bad = math.log(share), math.log(1 - share)
            for i, v in enumerate(p):
                bad, good = bad + math.log(chances[i][0][v]), good + math.log(chances[i][1][v])
            belief[p] = 1 / (1 + math.exp(min(500, max(-500, bad - good))))
    return belief, share


def plain_features(text):
    data = text.encode()
    out = np.zeros(4096)
    grams = len(data) - 2
    for i in range(grams):
        gram = data[i + 2] | data[i + 1] << 8 | data[i] << 16
        out[((gram * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1 / max(1, grams)
    for k, share in enumerate(plain_measures(text)[2], 1):
        out[mix(k) % 4096] += share
    return out


def test_quality_equals_an_independent_version(spark):
    rnd = random.Random(21)
    words = ["the", "and", "of", "kalomi", "neruka", "stolen", "garden", "is", "window", "in", "morning", "light"]
    clean = lambda: " ".join(" ".join(rnd.choices(words, k=9)).capitalize() + "." for _ in range(8))
    texts = [clean() for _ in range(40)] + [" ".join(w + "%$#" for w in rnd.choices(words, k=50)) for _ in range(8)]
    texts += ["spam spam spam buy " * 20 for _ in range(2)] + ["STOP NOW! " * 25, "x9 " * 60, "", "too short", "é " * 30 + clean()]
    texts += [texts[0]] * 2
    distinct = len(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in classify_quality(frame, train_rows=distinct).select("row.doc_id", "score").collect()}  # all are drawn
    belief, _ = plain_posteriors([plain_votes(t) for t in texts])
    used = [t for t in texts if plain_votes(t) in belief]
    x = np.array([np.append(plain_features(t), 1.0) for t in used])
    y = np.array([belief[plain_votes(t)] for t in used])
    w, power = np.zeros(4097), np.full(4097, 1e-12)
    for _ in range(300):
        gradient = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) @ x / len(used) + 1e-7 * w
        power += gradient ** 2
        w -= 0.5 * gradient / np.sqrt(power)
    want = {i: 1 / (1 + math.exp(-min(500, max(-500, float(np.append(plain_features(t), 1.0) @ w))))) for i, t in enumerate(texts)}
    assert len(got) == len(texts)
    assert max(abs(got[i] - want[i]) for i in want) < 5e-3  # the library adds in 32 bits
    assert {i for i in got if got[i] < 0.5} == {i for i in want if want[i] < 0.5} >= set(range(40, 48))


# ------------------------------------------------------------------ fingerprints

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_zero_bits(data, end):
    """Low zero bits of the rolling hash of the seven bytes before ``end``."""
    h = 0
    for back, byte in enumerate(reversed(data[max(0, end - 7):end]), 1):
        h = (h + (byte + 1) * pow(0x01000193, back, 1 << 32)) % (1 << 32)
    h ^= h >> 15
    h = h * 0x2C1B3C6D % (1 << 32)
    h ^= h >> 13
    return 32 if h == 0 else (h & -h).bit_length() - 1


def plain_signature(data, ends):
    out = []
    for begin, end in zip([0, *ends[:-1]], ends):
        h = 0
        for i, byte in enumerate(data[begin:end]):
            h = (h + (byte + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)) & MASK
        out.append(mix(h) >> 52)
    return out


def plain_print(text):
    data = text.encode()
    if not data:
        return 2, [], []
    zeros = {e: plain_zero_bits(data, e) for e in range(1, len(data))}
    bits = 2
    while sum(z >= bits for z in zeros.values()) + 1 > 64:
        bits += 1
    return bits, *(plain_signature(data, [*(e for e, z in sorted(zeros.items()) if z >= at), len(data)]) for at in (bits, bits + 1))


def shown(fingerprint):
    bits, *signatures = fingerprint
    return ":".join([str(1 << bits), *("".join(SYMBOLS[x >> 6] + SYMBOLS[x & 63] for x in s) for s in signatures)])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_likeness(x, y):
    best = 0.0
    for p, s in ((x[0], x[1]), (x[0] + 1, x[2])):
        for q, t in ((y[0], y[1]), (y[0] + 1, y[2])):
            if p == q:
                longer = max(len(s), len(t))
                best = max(best, 1 - distance(s, t) / longer if longer else 1.0)
    return best


def test_the_fingerprint_query_byte_by_byte(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = sorted(((d["doc_id"], d["text"] or "") for d in docs), reverse=True)
    got = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    short = [i for i in range(len(docs)) if len(docs[i][1]) < 4000 and len(docs[(i + 1) % len(docs)][1]) < 4000]
    assert len(short) > 40
    for i in short[:60]:  # each costs a pass over every byte in Python; all rows' lengths and edits are checked below
        (doc_id, text), (_, following) = docs[i], docs[(i + 1) % len(docs)]
        changed = text[:len(text) - len(text) // 3] + following[:len(text) // 3]
        own, other, after = plain_print(text), plain_print(changed), plain_print(following)
        row = got[doc_id]
        assert (row["fingerprint"], row["edited_fingerprint"]) == (shown(own), shown(other))
        assert abs(row["near_edited"] - plain_likeness(own, other)) < 1e-12 and abs(row["near_next"] - plain_likeness(own, after)) < 1e-12
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        changed = text[:len(text) - len(text) // 3] + following[:len(text) // 3]
        assert got[doc_id]["n_chars"] == len(text) and got[doc_id]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
