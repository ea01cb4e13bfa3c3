"""SQL of the training-data operators that SQL can express."""

from __future__ import annotations

from .merkle import FANOUT

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, unnest({_TERMS}) AS term FROM d),
n AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * docs) // total) AS m FROM n, s),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
 FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _levels(name: str, levels: int) -> list[str]:
    """CTEs from {name}0 (grp, pos, node, n): the nodes and the slots of each level, and each leaf's way and fold."""
    out = []
    for i in range(1, levels + 1):
        slots = ", ".join(f"coalesce(max(CASE WHEN pos % {FANOUT} = {j} THEN node END), '') AS s{j}" for j in range(FANOUT))
        out.append(f"{name}s{i} AS (SELECT grp, pos // {FANOUT} AS pos, max(n) AS n, {slots} FROM {name}{i - 1} GROUP BY grp, pos // {FANOUT})")
        both = " || ".join(f"s{j}" for j in range(FANOUT))
        out.append(f"{name}{i} AS (SELECT grp, pos, CASE WHEN n > 1 THEN sha256({both}) ELSE s0 END AS node, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}s{i})")
    return out


def _ways(name: str, begin: str, levels: int) -> list[str]:
    """CTEs from `begin` (grp, pos, way, fold and others): the siblings and the fold up to the top of {name}."""
    out = []
    for i in range(1, levels + 1):
        own = f"((pos // {FANOUT ** (i - 1)}) % {FANOUT})"
        rest = " || ".join(f"CASE WHEN {own} = {j} THEN '' ELSE s{j} END" for j in range(FANOUT))
        with_own = " || ".join(f"CASE WHEN {own} = {j} THEN fold ELSE s{j} END" for j in range(FANOUT))
        before = begin if i == 1 else f"{begin}{i - 1}"
        out.append(
            f"{begin}{i} AS (SELECT b.* REPLACE (CASE WHEN s.n > 1 THEN way || {rest.replace('pos', 'b.pos')} ELSE way END AS way, "
            f"CASE WHEN s.n > 1 THEN sha256({with_own.replace('pos', 'b.pos')}) ELSE fold END AS fold) FROM {before} b "
            f"JOIN {name}s{i} s ON s.grp = b.grp AND s.pos = b.pos // {FANOUT**i})"
        )
    return out


def merkle(low: int = 12, high: int = 4) -> str:
    """SQL of trees of up to `low` levels a source and `high` over the sources."""
    parts = [
        f"r AS (SELECT *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS grp, {_leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS bad FROM documents)",
        "l AS (SELECT doc_id, grp, leaf, bad, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM r)",
        "a0 AS (SELECT grp, pos, leaf AS node, n FROM l)", *_levels("a", low),
        "sub AS (SELECT grp, node AS subroot FROM a%d WHERE pos = 0)" % low,
        "b0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, subroot AS node, count(*) OVER () AS n, grp AS src FROM sub)", *_levels("b", high),
        "u AS (SELECT grp, pos, doc_id, leaf, '' AS way, coalesce(bad, leaf) AS fold FROM l)", *_ways("a", "u", low),
        f"v AS (SELECT 0 AS grp, b0.pos AS pos, doc_id, leaf, b0.node AS subroot, way, fold FROM u{low} JOIN b0 ON b0.src = u{low}.grp)", *_ways("b", "v", high),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(way) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM v{high}, (SELECT node AS root FROM b{high})"


ORACLE_SQL: dict[str, str] = {"op11_lexical": RANKED, "op12_merkle": merkle()}
