"""The sequence kernels as SQL, so that the oracle computes the same features from the letters on.

Sequences are cut into stretches, since a substring of a long text costs its place; codes of
k-mers come from joins with small tables of all words of a few letters.
"""

from __future__ import annotations

from strandlake.functions import kernels

ALL = (1 << 64) - 1


def times(x: str, by: int) -> str:
    """The low 64 bits of a product of unsigned numbers."""
    return f"(({x})::UHUGEINT * {by}::UHUGEINT & {ALL}::UHUGEINT)::UBIGINT"


def plus(x: str, by: int) -> str:
    return f"((({x})::UHUGEINT + {by}::UHUGEINT) & {ALL}::UHUGEINT)::UBIGINT"


def rotated(x: str, by: int) -> str:
    return f"(((({x})::UHUGEINT << {by}) & {ALL}::UHUGEINT)::UBIGINT | ({x} >> {64 - by}))"


def words(k: int) -> str:
    """w{k}: all words w of k bases with the codes f of themselves and r of their reverse complements."""
    at = [f"((x >> {2 * (k - 1 - j)}) & 3)" for j in range(k)]
    text = " || ".join(f"substr('ACGT', {d}::INTEGER + 1, 1)" for d in at)
    back = " + ".join(f"(3 - {d}) * {4**j}" for j, d in enumerate(at))
    return f"w{k} AS (SELECT {text} AS w, x::UBIGINT AS f, ({back})::UBIGINT AS r FROM range({4**k}) t(x))"


def mixed(name: str, source: str, keep: str) -> str:
    """`name`: the columns `keep` and h, the packed mix of x, step by step."""
    p1, p2, p3, p4, p5 = kernels.XXH_PRIMES
    steps = [times("x", p2), f"xor({p5 + 8}::UBIGINT, {times(rotated('x', 31), p1)})", plus(times(rotated("x", 27), p1), p4), times("xor(x, x >> 33)", p2), times("xor(x, x >> 29)", p3)]
    out = ""
    for i, step in enumerate(steps):
        out += f"{name}_{i} AS (SELECT {keep}, {step} AS x FROM {source if i == 0 else f'{name}_{i - 1}'}),\n"
    return out + f"{name} AS (SELECT {keep}, xor(x, x >> 32) AS h FROM {name}_{len(steps) - 1})"


def coded(name: str, table: str, key: str, parts: list[int]) -> str:
    """`name`: key, pos, the canonical code x of each k-mer of table.seq, and whether it is that of the reverse; words of `parts` letters make a k-mer."""
    k = sum(parts)
    starts = [sum(parts[:i]) for i in range(len(parts))]
    cut = ", ".join(f"substr(part, i + {s}, {n}) AS p{j}" for j, (s, n) in enumerate(zip(starts, parts)))
    joins = " ".join(f"JOIN w{n} t{j} ON t{j}.w = p{j}" for j, n in enumerate(parts))
    fwd = " + ".join(f"t{j}.f * {4 ** (k - s - n)}::UBIGINT" for j, (s, n) in enumerate(zip(starts, parts)))
    rev = " + ".join(f"t{j}.r * {4**s}::UBIGINT" for j, s in enumerate(starts))
    return f"""{name}_c AS (SELECT {key}, o, substr(seq, o + 1, 283) AS part FROM {table}, unnest(range(0, length(seq) - {k - 1}, 256)) u(o)),
{name}_p AS (SELECT {key}, o + i AS pos, {cut} FROM {name}_c, unnest(range(1, least(length(part) - {k - 1}, 256) + 1)) u(i)),
{name} AS (SELECT {key}, pos, least(f, r) AS x, (f > r)::INTEGER AS strand FROM (SELECT {key}, pos, {fwd} AS f, {rev} AS r FROM {name}_p {joins}))"""


def syncmers(name: str, table: str, key: str) -> str:
    """`name`: key, pos and h of the open syncmers, k-mers of 28 whose ninth 12-mer has the least mix of seventeen."""
    return f"""{coded(f"{name}_s", table, key, [6, 6])},
{mixed(f"{name}_m", f"{name}_s", f"{key}, pos")},
{name}_o AS (SELECT {key}, pos - 8 AS pos FROM (SELECT *, min(h) OVER w AS least, count(*) OVER w AS n FROM {name}_m WINDOW w AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) WHERE h = least AND n = 17),
{name}_k AS (SELECT {key}, pos, {", ".join(f"substr(kmer, {7 * j + 1}, 7) AS p{j}" for j in range(4))} FROM (SELECT y.{key}, y.pos, substr(part, (y.pos - c.o)::BIGINT, 28) AS kmer FROM {name}_o y JOIN {name}_s_c c ON c.{key} = y.{key} AND c.o = (y.pos - 1) // 256 * 256)),
{name}_x AS (SELECT {key}, pos, least({" + ".join(f"t{j}.f * {4 ** (21 - 7 * j)}::UBIGINT" for j in range(4))}, {" + ".join(f"t{j}.r * {4 ** (7 * j)}::UBIGINT" for j in range(4))}) AS x
  FROM {name}_k {" ".join(f"JOIN w7 t{j} ON t{j}.w = p{j}" for j in range(4))}),
{name}_c AS (SELECT {key}, o, substr(seq, o + 1, 283) AS part FROM {table}, unnest(range(0, length(seq) - 27, 256)) u(o)),
{mixed(name, f"{name}_x", f"{key}, pos")}"""


def features(name: str, table: str, key: str) -> str:
    """`name`: key, pos and hash of the strobemers, of sequences long enough; and `name`_y, the syncmers."""
    main = kernels.STROBE_MASK
    both = [f"((({a} & {main}::UBIGINT) | ({b} & {ALL ^ main}::UBIGINT)) & {ALL ^ 255}::UBIGINT)" for a, b in (("h", "p"), ("p", "h"))]
    return f"""{name}_l AS (SELECT * FROM {table} WHERE length(seq) >= 67),
{syncmers(f"{name}_y", f"{name}_l", key)},
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i FROM {name}_y),
{name}_q AS (SELECT a.{key}, a.pos, a.h, coalesce(arg_min(b.h, (bit_count(xor(a.h, b.h) & 255::UBIGINT)::BIGINT, b.i)), a.h) AS p
  FROM {name}_i a LEFT JOIN {name}_i b ON b.{key} = a.{key} AND b.i BETWEEN a.i + 12 AND a.i + 32 AND b.pos <= a.pos + 60 GROUP BY 1, 2, 3),
{name} AS (SELECT {key}, pos, (least({both[0]}, {both[1]}) >> 8)::BIGINT AS hash FROM {name}_q)"""


def minimizers(name: str, table: str, key: str) -> str:
    """`name`: key, pos, code and strand of the minimizers, 15-mers of the least mix in ten in a row."""
    one, two = kernels.MURMUR
    return f"""{coded(f"{name}_s", table, key, [5, 5, 5])},
{name}_1 AS (SELECT *, {times("xor(x, x >> 33)", one)} AS m FROM {name}_s),
{name}_2 AS (SELECT * REPLACE ({times("xor(m, m >> 33)", two)} AS m) FROM {name}_1),
{name}_b AS (SELECT *, min({{'r': xor(m, m >> 33), 'p': pos, 'x': x, 's': strand}}) OVER w AS b, count(*) OVER w AS n, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i
  FROM {name}_2 WINDOW w AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
{name} AS (SELECT DISTINCT {key}, b.p AS pos, b.x::BIGINT AS code, b.s AS strand FROM {name}_b WHERE n = 10)"""


TABLES = ",\n".join(words(k) for k in (5, 6, 7))
