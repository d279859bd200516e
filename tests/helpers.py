import math
import random


def km(a, b):
    p1, l1, p2, l2 = map(math.radians, (*a, *b))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 12742 * math.asin(min(1.0, math.sqrt(h)))


def scatter(n, seed, lat=3.0, lon=101.4, span=0.05):
    r = random.Random(seed)
    return [(i, lat + r.random() * span, lon + r.random() * span) for i in range(n)]


def tuples(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
