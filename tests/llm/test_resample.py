import hashlib
import math
import random
import re
import zlib

import pytest

from hearthflow.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]
    return len(words), runs


def brute(rows, target, longest, buckets, percent, least):
    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counted(x for _, x in rows), counted(target)
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets))))
        for a, b in zip(s, t)
    ]
    out, able = [], []
    for i, text in rows:
        n, found = features(text, longest)
        total = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        weight = total // len(found) if found else 0
        name = "" if i is None else str(i)
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for place, row in enumerate(able[: len(able) * percent // 100]):
        row[4] = place + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest,buckets,least", [(2, 10_000, 20), (1, 7, 0), (3, 500, 2)])
def test_against_brute_force(spark, documents, odd_rows, longest, buckets, least):
    rng = random.Random(5)
    some = ["alpha", "Beta", "gamma7", "dÉlta", "İx", "ω", "a-b", "x_y", "z\x00q"]
    rows = [*odd_rows, *((100 + i, " ".join(rng.choices(some, k=rng.randint(0, 60)))) for i in range(80))]
    target = [" ".join(rng.choices(some[:4], k=30)) for _ in range(9)] + [None, ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    got = resample.resample(documents(rows), aim, 25, least, longest=longest, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, longest, buckets, 25, least)


def test_empty_tables(spark, documents):
    aim = spark.createDataFrame([], "text string")
    assert resample.resample(documents([]), aim).collect() == []
    rows = [(1, None), (2, "a b " * 20)]
    got = resample.resample(documents(rows), aim).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, [], 2, 10_000, 25, 20)
