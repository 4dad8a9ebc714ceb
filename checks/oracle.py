"""DuckDB SQL that computes each registered query another way.

Product names are composed from an article number, so product, weight, tokens
and attributes are stated here from that number, not parsed from the text.
``r(x, n)`` rounds and turns a negative zero into zero.
"""

from __future__ import annotations

import math

HEADS = ["Сельдь", "Скумбрия", "Форель", "Сёмга", "Килька", "Кета", "Икра", "Мойва", "Анчоус",
         "Спред", "Имбирь", "Ассорти"]
STYLES = ["копченая", "с/с", "филе", "маринованная в/у", "п/п"]
CATEGORIES = ["Сельдь и икра", "Скумбрия и мойва", "Форель и анчоусы", "Сёмга и спреды",
              "Килька и имбирь", "Кета и ассорти"]
PRODUCTS = ["сельдь", "скумбрия", "форель", "семга", "килька", "кета", "икра", "мойва", "анчоус",
            "спред", "имбирь", None]
PROCESSING = ["копченый", "слабосоленый", None, "маринованный", "пряного посола"]
STYLE_TOKENS = [["копченая"], ["слабосоленый"], ["филе"], ["маринованная", "вакуумная", "упаковка"],
                ["пряного", "посола"]]
STYLE_ROOTS = [["копч"], [], ["филе"], ["мари"], []]
FOLDS, SEED, REPS, WITHIN_REPS = 5, 42, 200, 300
GRID = [0, 5, 10, 15, 20, 25, 30]
CURVE = GRID + [35, 40]
Z = 1.959963984540054


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(lit(x) for x in v) + "]" + ("::VARCHAR[]" if not v else "")
    return repr(v)


def pick(values: list, at: str) -> str:
    return f"({lit(values)})[CAST(({at}) % {len(values)} AS INTEGER) + 1]"


def tenth(x: str, unit: int = 100_000) -> str:
    """Half-even to one digit (or to ``unit`` millionths), on millionths, so that ties are exact."""
    m = f"CAST(round(abs({x}) * 1e6) AS BIGINT)"
    return (f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (({m} // {unit}) + CASE WHEN {m} % {unit} > {unit // 2} THEN 1 "
            f"WHEN {m} % {unit} = {unit // 2} THEN ({m} // {unit}) % 2 ELSE 0 END) / {1_000_000 // unit}e0)")


def r(x: str, n: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {n}) + 0.0"


def h60(*parts: str) -> str:
    text = " || '#' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def erfc(x: str) -> str:
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
         1.48851587, -0.82215223, 0.17087277)
    t = f"(1e0 / (1e0 + 0.5e0 * abs({x})))"
    poly = f"({c[-1]!r}e0)"
    for a in reversed(c[:-1]):
        poly = f"(({a!r}e0) + {t} * {poly})"
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(CASE WHEN ({x}) >= 0 THEN {tail} ELSE 2e0 - {tail} END)"


def grams(i: str) -> str:
    return f"(10 * (1 + ({i}) % 50))"


def name(i: str) -> str:
    kilos = f"(CAST({grams(i)} // 1000 AS VARCHAR) || '.' || lpad(CAST({grams(i)} % 1000 AS VARCHAR), 3, '0'))"
    g = f"CAST({grams(i)} AS VARCHAR)"
    return (f"({pick(HEADS, i)} || ' ' || {pick(STYLES, i)} || ' ' || CASE ({i}) % 7 "
            f"WHEN 0 THEN replace({kilos}, '.', ',') || ' кг' WHEN 1 THEN {g} || ' г' "
            f"WHEN 2 THEN {g} || 'гр.' WHEN 3 THEN {kilos} WHEN 4 THEN {g} WHEN 5 THEN 'вес' "
            f"ELSE '1/6 ' || {g} || 'г' END)")


def weight_method(i: str) -> str:
    return (f"(CASE ({i}) % 7 WHEN 0 THEN 'кг' WHEN 1 THEN 'г' WHEN 2 THEN 'г' "
            f"WHEN 3 THEN CASE WHEN {grams(i)} BETWEEN 20 AND 5000 THEN 'голое-кг' ELSE 'нет' END "
            f"WHEN 4 THEN CASE WHEN {grams(i)} BETWEEN 50 AND 2000 THEN 'голое-г' ELSE 'нет' END "
            f"WHEN 5 THEN 'весовой' ELSE 'г' END)")


def weight_g(i: str) -> str:
    return (f"(CASE WHEN ({i}) % 7 = 5 OR ({i}) % 7 = 3 AND {grams(i)} < 20 "
            f"OR ({i}) % 7 = 4 AND {grams(i)} < 50 THEN NULL ELSE CAST({grams(i)} AS DOUBLE) END)")


def tokens(i: str) -> str:
    lists = "CASE CAST(({i}) % 5 AS INTEGER) " + " ".join(
        f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(STYLE_TOKENS)) + " END"
    head = f"replace(lower({pick(HEADS, i)}), 'ё', 'е')"
    return (f"list_sort(list_distinct(list_concat([{head}], {lists.format(i=i)}, "
            f"CASE WHEN ({i}) % 7 = 5 THEN ['вес'] ELSE []::VARCHAR[] END)))")


def roots(head: str, style: str) -> str:
    lists = f"CASE CAST(({style}) % 5 AS INTEGER) " + " ".join(
        f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(STYLE_ROOTS)) + " END"
    first = f"substr(replace(lower({pick(HEADS, head)}), 'ё', 'е'), 1, 4)"
    return f"list_sort(list_distinct(list_concat([{first}], {lists})))"


# Names that reach every rule: word, product; colour word, colour; abbreviation, processing, packaging, tokens.
ODD_HEADS = [("Имбирь", "имбирь"), ("Анчоус", "анчоус"), ("Хамса", "анчоус"), ("Килька", "килька"), ("Икра", "икра"),
             ("Капуста", "морская капуста"), ("Скумбрия", "скумбрия"), ("Сельдь", "сельдь"), ("Сёмга", "семга"), ("Форель", "форель"),
             ("Горбуша", "горбуша"), ("Салака", "салака"), ("Мойва", "мойва"), ("Ставрида", "ставрида"), ("Креветка", "креветка"),
             ("Паштет", "паштет"), ("Спред", "спред"), ("Пресервы", "пресервы"), ("Морепродукты", "морепродукты"), ("Масло", "масло"),
             ("Мидии", "мидии"), ("Кальмар", "кальмар"), ("Осьминог", "осьминог"), ("Тунец", "тунец"), ("Лосось", "лосось"),
             ("Кета", "кета"), ("Сардина", "сардина"), ("Масляная", "масляная рыба"), ("Треска", "треска"), ("Минтай", "минтай"),
             ("Краб", "краб"), ("Путассу", "путассу"), ("Сайра", "сайра"), ("Салат", "салат"), ("Ассорти", None)]
ODD_COLOURS = [("красная", "красный"), ("чёрная", "черный"), ("розовая", "розовый"), ("белая", "белый"), ("", None)]
ODD_SHORT = [("с/с", "слабосоленый", None, ["слабосоленый"]), ("п/п", "пряного посола", None, ["пряного", "посола"]),
             ("пр/посола", "пряного посола", None, ["пряного", "посола"]), ("пр/п", None, None, ["пряного", "посола"]),
             ("в/у", None, "вакуум", ["вакуумная", "упаковка"]), ("в/м", None, None, ["масле"]),
             ("г/к", "копченый", None, ["горячего", "копчения"]), ("х/к", "копченый", None, ["холодного", "копчения"]), ("", None, None, [])]


def odd_names() -> str:
    head, colour, short = (lambda k: pick([x[k] for x in ODD_HEADS], "i")), (lambda k: pick([x[k] for x in ODD_COLOURS], "i // 3")), \
        (lambda k: pick([x[k] for x in ODD_SHORT], "i // 7"))
    tokens = "CASE CAST((i // 7) % 9 AS INTEGER) " + " ".join(f"WHEN {k} THEN {lit(x[3])}" for k, x in enumerate(ODD_SHORT)) + " END"
    plain = lambda x: f"replace(lower({x}), 'ё', 'е')"
    return f"""WITH n AS (SELECT DISTINCT p_partkey AS i, 10 * (1 + p_partkey % 900) AS g, (p_partkey // 2) % 8 AS s FROM part),
        k AS (SELECT *, CAST(g // 1000 AS VARCHAR) || '.' || lpad(CAST(g % 1000 AS VARCHAR), 3, '0') AS kilos FROM n),
        w AS (SELECT *, CASE s WHEN 0 THEN replace(kilos, '.', ',') || ' кг' WHEN 1 THEN kilos WHEN 2 THEN g || ' г' WHEN 3 THEN CAST(g AS VARCHAR)
            WHEN 4 THEN 'весовая' WHEN 5 THEN 'вес' WHEN 6 THEN '1/2 ' || g || 'гр' ELSE '' END AS weight FROM k)
        SELECT DISTINCT array_to_string(list_filter([{head(0)}, {colour(0)}, {short(0)}, weight], lambda x: x <> ''), ' ') AS name,
            CASE WHEN s = 0 THEN 'кг' WHEN s = 1 AND g BETWEEN 20 AND 5000 THEN 'голое-кг' WHEN s IN (2, 6) THEN 'г'
                 WHEN s = 3 AND g BETWEEN 50 AND 2000 THEN 'голое-г' WHEN s IN (4, 5) THEN 'весовой' ELSE 'нет' END AS weight_method,
            CASE WHEN s IN (0, 2, 6) OR s = 1 AND g BETWEEN 20 AND 5000 OR s = 3 AND g BETWEEN 50 AND 2000 THEN CAST(g AS DOUBLE) END AS weight_g,
            {head(1)} AS product, {short(1)} AS processing, CAST(NULL AS VARCHAR) AS form, {short(2)} AS packaging, {colour(1)} AS colour,
            array_to_string(list_sort(list_distinct(list_filter(list_concat([{plain(head(0))}, {plain(colour(0))}], {tokens},
                CASE s WHEN 4 THEN ['весовая'] WHEN 5 THEN ['вес'] ELSE []::VARCHAR[] END), lambda x: x <> ''))), ' ') AS tokens
        FROM w"""


LINES = """lines AS (
  SELECT l_partkey // 20 AS i, 'S' || CAST(l_partkey // 20 AS VARCHAR) AS sku, c_mktsegment AS client,
         CAST(l_shipdate AS DATE) AS date, l_quantity AS qty, l_returnflag AS type,
         CAST(6 * greatest(0, CAST(round(l_discount * 100) AS INTEGER) - 5) AS DOUBLE) AS disc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SALES_M = f"""cells0 AS (
  SELECT sku, client, CAST(date_trunc('month', date) AS DATE) AS month, min(i) AS i, sum(qty) AS qty,
         max(disc) AS own_disc, avg(disc) AS promo_disc_mean,
         count(*) FILTER (WHERE disc > 0) AS promo_weeks
  FROM lines GROUP BY 1, 2, 3),
types AS (
  SELECT sku, client, month, type FROM (
    SELECT *, row_number() OVER (PARTITION BY sku, client, month ORDER BY n DESC, type) AS rn FROM (
      SELECT sku, client, CAST(date_trunc('month', date) AS DATE) AS month, type, count(*) AS n
      FROM lines GROUP BY 1, 2, 3, 4)) WHERE rn = 1),
panel AS (
  SELECT c.sku, c.client, c.month, c.i, greatest(c.qty, 0e0) AS qty, t.type,
         {pick(CATEGORIES, 'c.i')} AS category, 'G' || CAST(c.i % 12 AS VARCHAR) AS grp,
         {name('c.i')} AS name, own_disc, promo_disc_mean, CAST(promo_weeks AS BIGINT) AS promo_weeks
  FROM cells0 c JOIN types t USING (sku, client, month))"""

_W = "(PARTITION BY sku, client ORDER BY month"
FEATURES = f"""features AS (
  SELECT *, month(month) AS month_num, quarter(month) AS quarter,
    sin(2 * pi() * month(month) / 12e0) AS m_sin, cos(2 * pi() * month(month) / 12e0) AS m_cos,
    CASE WHEN month(month) IN (11, 12, 1, 2) THEN 1 ELSE 0 END AS is_high_season,
    {', '.join(f"coalesce(lag(qty, {k}) OVER {_W}), 0e0) AS lag_qty_{k}" for k in (1, 2, 3, 6, 12))},
    coalesce(avg(qty) OVER {_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0e0) AS roll3_qty_mean,
    coalesce(avg(qty) OVER {_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0e0) AS roll6_qty_mean,
    coalesce(stddev_samp(qty) OVER {_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0e0) AS roll3_qty_std,
    ln(1 + greatest(qty, 0e0)) AS y,
    {h60("sku || '|' || client || '|' || strftime(month, '%Y-%m-%d')", SEED)} % {FOLDS} AS fold
  FROM panel)"""

BASE = f"WITH RECURSIVE {LINES}, {SALES_M}"
FEATURED = f"{BASE}, {FEATURES}"


def using(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys) or "TRUE"


def cell_residuals(src: str, out: str, targets: list[str], cells: list[str], by: list[str],
                   keep: list[str]) -> str:
    """CTE ``out``: ``src`` rows with <target>_r, means taken over the other folds."""
    keys = list(dict.fromkeys(by + cells))
    sums = ", ".join(f"sum({t}) AS s_{t}" for t in targets)
    k = ", ".join(keys)
    b = ", ".join(by) + (", " if by else "")
    outs = ", ".join(
        f"x.{t} - CASE WHEN c.n - f.n > 0 THEN (c.s_{t} - f.s_{t}) / (c.n - f.n) "
        f"ELSE (a.s_{t} - g.s_{t}) / (a.n - g.n) END AS {t}_r" for t in targets)
    group_by = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""{out}_f AS (SELECT {k}, fold, count(*) AS n, {sums} FROM {src} GROUP BY {k}, fold),
{out}_c AS (SELECT {k}, sum(n) AS n, {', '.join(f'sum(s_{t}) AS s_{t}' for t in targets)} FROM {out}_f GROUP BY {k}),
{out}_g AS (SELECT {b}fold, sum(n) AS n, {', '.join(f'sum(s_{t}) AS s_{t}' for t in targets)} FROM {out}_f GROUP BY {b}fold),
{out}_a AS (SELECT {b}sum(n) AS n, {', '.join(f'sum(s_{t}) AS s_{t}' for t in targets)} FROM {out}_f {group_by}),
{out} AS (SELECT {', '.join('x.' + c for c in keep)}, {outs} FROM {src} x
  JOIN {out}_f f ON {using(keys + ['fold'], 'x', 'f')} JOIN {out}_c c ON {using(keys, 'x', 'c')}
  JOIN {out}_g g ON {using(by + ['fold'], 'x', 'g')} JOIN {out}_a a ON {using(by, 'x', 'a')})"""


def slope(src: str, out: str, x: str, y: str, by: list[str]) -> str:
    """CTEs ``out``_m (sums per SKU) and ``out`` (theta, se, p, lo, hi per group)."""
    b = ", ".join(by) + (", " if by else "")
    g = f"GROUP BY {', '.join(by)}" if by else ""
    gm = "GROUP BY " + ", ".join([f"m.{c}" for c in by] + ["l.theta", "l.n", "l.g", "l.spread"])
    return f"""{out}_m AS (SELECT {b}sku, CAST(count(*) AS DOUBLE) AS n, sum({x}) AS sx, sum({y}) AS sy,
    sum({x} * {x}) AS sxx, sum({x} * {y}) AS sxy FROM {src} GROUP BY {b}sku),
{out}_t AS (SELECT {b}sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy,
    count(*) AS g FROM {out}_m {g}),
{out}_l AS (SELECT *, sx / n AS mean, sxx - sx * sx / n AS spread,
    (sxy - sx * sy / n) / (sxx - sx * sx / n) AS theta,
    (sy - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx) / n AS icpt FROM {out}_t),
{out}_s AS (SELECT {', '.join('m.' + c for c in by) + (', ' if by else '')}l.theta AS theta, sqrt(sum(power(
    m.sxy - l.icpt * m.sx - l.theta * m.sxx - l.mean * (m.sy - l.icpt * m.n - l.theta * m.sx), 2))
    * l.g / (l.g - 1) * (l.n - 1) / (l.n - 2)) / l.spread AS se
  FROM {out}_m m JOIN {out}_l l ON {using(by, 'm', 'l')} {gm}),
{out} AS (SELECT *, {erfc(f'theta / se / sqrt(2e0)').replace('theta / se', 'abs(theta / se)')} AS p,
    theta - {Z} * se AS lo, theta + {Z} * se AS hi FROM {out}_s)"""


def draws(moments: str, out: str, columns: list[str], reps: int, seed: int = SEED) -> str:
    """CTE ``out``: per replicate, sums of ``columns`` over clusters drawn with replacement."""
    return f"""{out}_n AS (SELECT *, row_number() OVER (ORDER BY sku) AS place, count(*) OVER () AS g FROM {moments}),
{out}_d AS (SELECT rep, {h60('rep', 'place', seed)} % g + 1 AS place
    FROM {out}_n, (SELECT unnest(generate_series(1, {reps})) AS rep)),
{out} AS (SELECT rep, {', '.join(f'sum({c}) AS {c}' for c in columns)} FROM {out}_d JOIN {out}_n USING (place) GROUP BY rep)"""


# --- linear controls and category levels, fitted outside each fold ----------

CONTROLS = ["m_sin", "m_cos", "is_high_season", "month_num", "quarter", "lag_qty_1", "lag_qty_2", "lag_qty_3",
            "lag_qty_6", "lag_qty_12", "roll3_qty_mean", "roll6_qty_mean", "roll3_qty_std"]


def linear(src: str, out: str, xs: list[str], targets: list[str], by: list[str], keep: list[str],
           folds: str = f"unnest(generate_series(0, {FOLDS - 1}))") -> str:
    """CTE ``out``: <target>_r of least squares on ``xs`` with a level per category; Gauss elimination, one CTE a pivot."""
    keys = list(dict.fromkeys([*by, "category"]))
    p, cols = len(xs), xs + targets
    b = "".join(f", x.{c}" for c in by)
    bare = "".join(f", {c}" for c in by)
    dev = [f"(CAST(x.{c} AS DOUBLE) - m.m_{c})" for c in cols]
    cov = ", ".join(f"sum({dev[i]} * {dev[j]}) AS a_{i}_{j}" for i in range(p) for j in range(i, len(cols)))
    means = ", ".join(f"avg(CAST(x.{c} AS DOUBLE)) AS m_{c}" for c in cols)
    steps = [f"{out}_g0 AS MATERIALIZED (SELECT f{bare}, "
             + ", ".join(f"a_{min(i, j)}_{max(i, j)} AS a_{i}_{j}" for i in range(p) for j in range(len(cols)))
             + f" FROM {out}_c)"]
    for k in range(p):
        cells = [f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}"
                 for i in range(p) for j in range(k + 1, len(cols))]
        steps.append(f"{out}_g{k + 1} AS MATERIALIZED (SELECT f{bare}, {', '.join(cells)} FROM {out}_g{k})")
    res = ", ".join(f"x.{t} - m.m_{t}" + "".join(f" - b.a_{i}_{p + n} * {dev[i]}" for i in range(p)) + f" AS {t}_r"
                    for n, t in enumerate(targets))
    same = "".join(f" AND b.{c} = x.{c}" for c in by)
    at = " AND ".join(f"m.{c} = x.{c}" for c in keys)
    return f"""{out}_o AS (SELECT {folds} AS f),
{out}_m AS MATERIALIZED (SELECT o.f, {', '.join('x.' + c for c in keys)}, {means} FROM {src} x JOIN {out}_o o ON x.fold <> o.f GROUP BY ALL),
{out}_c AS MATERIALIZED (SELECT o.f{b}, {cov} FROM {src} x JOIN {out}_o o ON x.fold <> o.f JOIN {out}_m m ON m.f = o.f AND {at} GROUP BY ALL),
{', '.join(steps)},
{out} AS (SELECT {', '.join('x.' + c for c in keep)}, {res} FROM {src} x JOIN {out}_m m ON m.f = x.fold AND {at}
    JOIN {out}_g{p} b ON b.f = x.fold{same})"""


SUMS = ["n", "sx", "sy", "sxx", "sxy"]
SLOPE = "(sxy - sx * sy / n) / (sxx - sx * sx / n)"
ROWS = "rows0 AS (SELECT *, own_disc AS t FROM features)"
CELLS = ["category", "month_num"]
EFFECT = (f"{FEATURED}, {ROWS}, "
          + linear("rows0", "res", CONTROLS, ["y", "t"], [], ["sku"]) + ", "
          + slope("res", "eff", "t_r", "y_r", []))
SUPPORTED = """rows1 AS (SELECT * FROM rows0 WHERE category IN (
  SELECT category FROM rows0 GROUP BY category
  HAVING count(*) >= 400 AND count(*) FILTER (WHERE t > 0) >= 60))"""
CATE = (f"{SUPPORTED}, "
        + linear("rows1", "cres", CONTROLS, ["y", "t"], ["category"], ["category", "sku"]) + ", "
        + slope("cres", "cate", "t_r", "y_r", ["category"]))
EFFECT_COLS = ", ".join(f"{r(c)} AS {c}" for c in ("theta", "se", "p", "lo", "hi"))


def quantile_pair(x: str, a: float, b: float) -> str:
    return f"quantile_cont({x}, {a}) AS qlo, quantile_cont({x}, {b}) AS qhi"


# --- prices -----------------------------------------------------------------

PRICED = f"""pl AS (
  SELECT {pick(PRODUCTS, 'p_partkey')} AS product,
         p_retailprice * 0.75e0 / ({weight_g('p_partkey')} / 1000e0) AS entry_kg,
         p_retailprice / ({weight_g('p_partkey')} / 1000e0) AS shelf_kg
  FROM part WHERE {weight_g('p_partkey')} IS NOT NULL),
ok AS (SELECT * FROM pl WHERE entry_kg BETWEEN 100 AND 15000 AND shelf_kg BETWEEN 100 AND 15000),
heads AS (SELECT product, quantile_cont(entry_kg, 0.5) AS entry_kg, quantile_cont(shelf_kg, 0.5) AS shelf_kg,
          count(*) AS n FROM ok WHERE product IS NOT NULL GROUP BY product),
overall AS (SELECT quantile_cont(entry_kg, 0.5) AS e, quantile_cont(shelf_kg, 0.5) AS s FROM ok)"""

PRICES = f"""{PRICED}, items AS (SELECT DISTINCT sku, i FROM lines),
ptable AS (
  SELECT sku, {name('i')} AS name, {pick(CATEGORIES, 'i')} AS category, 'G' || CAST(i % 12 AS VARCHAR) AS grp,
    {pick(PRODUCTS, 'i')} AS product, {weight_method('i')} AS weight_method, {weight_g('i')} AS weight_g,
    CASE WHEN h.product IS NOT NULL THEN 'по продукту' ELSE 'запасная медиана' END AS price_method,
    CASE WHEN h.product IS NOT NULL THEN h.entry_kg ELSE overall.e END AS entry_kg,
    CASE WHEN h.product IS NOT NULL THEN h.shelf_kg ELSE overall.s END AS shelf_kg
  FROM items LEFT JOIN heads h ON h.product = {pick(PRODUCTS, 'i')}, overall)"""

# --- planning ---------------------------------------------------------------

COST = 0.3
PLANNING = f"""{PRICES}, {CATE},
priced AS (SELECT p.*, p.grp AS pgrp, {tenth('t.entry_kg * t.weight_g / 1000e0')} AS price_unit
           FROM panel p LEFT JOIN ptable t USING (sku)),
base AS (SELECT * FROM (
  SELECT sku, quantile_cont(qty, 0.5) AS base_qty, min(category) AS cat, min(pgrp) AS grp,
         min(price_unit) AS price_unit FROM priced WHERE own_disc = 0 GROUP BY sku)
  WHERE price_unit IS NOT NULL AND base_qty > 0),
based AS (SELECT b.*, coalesce(c.theta, e.theta) AS th,
            CASE WHEN c.theta IS NULL THEN e.theta ELSE c.lo END AS th_lo
          FROM base b LEFT JOIN cate c ON c.category = b.cat, eff e),
cand AS (SELECT sku, cat, grp, d,
    base_qty * exp(th * d) * (price_unit * (1 - d / 100) - {COST}e0 * price_unit) - base_qty * (price_unit - {COST}e0 * price_unit) AS net,
    base_qty * exp(th_lo * d) * (price_unit * (1 - d / 100) - {COST}e0 * price_unit) - base_qty * (price_unit - {COST}e0 * price_unit) AS net_robust,
    base_qty * exp(th * d) * price_unit * (1 - d / 100) - base_qty * price_unit AS rev,
    base_qty * exp(th * d) * price_unit * (d / 100) AS spend
  FROM based, (SELECT CAST(unnest({GRID}) AS DOUBLE) AS d)),
hist AS (SELECT sku, avg(own_disc) AS d FROM panel WHERE own_disc > 0 GROUP BY sku),
past AS (SELECT sum(base_qty * exp(th * d) * price_unit * (d / 100)) AS hist_spend,
    sum(greatest(base_qty * exp(th * d) * (price_unit * (1 - d / 100) - {COST}e0 * price_unit)
        - base_qty * (price_unit - {COST}e0 * price_unit), 0)) AS hist_net
  FROM hist JOIN based USING (sku))"""


def greedy(share: float, objective: str = "net") -> str:
    """CTE ``plan``: one candidate per step, in order, taken when every limit allows."""
    return f"""best AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY obj DESC, sku) AS rn FROM (
    SELECT *, {objective} AS obj, row_number() OVER (PARTITION BY sku ORDER BY {objective} DESC, spend, d) AS k
    FROM cand WHERE d > 0 AND {objective} > 0) WHERE k = 1),
money AS MATERIALIZED (SELECT hist_spend * {share}e0 AS budget FROM past),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, 0e0 AS spent, 0 AS used, []::VARCHAR[] AS grps, FALSE AS take
  UNION ALL
  SELECT rn, CASE WHEN ok THEN spent + spend ELSE spent END, CASE WHEN ok THEN used + 1 ELSE used END,
         CASE WHEN ok THEN list_append(grps, grp) ELSE grps END, ok FROM (
    SELECT b.rn AS rn, w.spent AS spent, w.used AS used, w.grps AS grps, b.spend AS spend, b.grp AS grp,
      w.used < 200 AND w.spent + b.spend <= m.budget
      AND len(list_filter(w.grps, lambda g: g = b.grp)) < 3 AS ok
    FROM walk w JOIN best b ON b.rn = w.rn + 1, money m)),
plan AS (SELECT b.* FROM best b JOIN walk w USING (rn) WHERE w.take)"""


PLAN_COLS = ("sku, cat, grp AS \"group\", d, "
             + ", ".join(f"{r(c, 2)} AS {c}" for c in ("net", "net_robust", "rev", "spend")))
PRICE_STEPS = 48
LAGRANGE = f"""pos AS (SELECT *, net AS obj FROM cand WHERE d > 0 AND net > 0),
top AS (SELECT max(obj / spend) AS t FROM pos),
lam AS (SELECT 0e0 AS price UNION ALL SELECT t * 1.001e0 * power(0.001e0, 1 - i / {PRICE_STEPS - 1}e0)
        FROM top, (SELECT unnest(generate_series(0, {PRICE_STEPS - 1})) AS i)),
each1 AS (SELECT *, obj - price * spend AS worth FROM pos, lam WHERE obj - price * spend > 0),
each2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price, sku ORDER BY worth DESC, spend, d) AS k1 FROM each1) WHERE k1 = 1),
each3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price, grp ORDER BY worth DESC, spend, d, sku) AS k2 FROM each2) WHERE k2 <= 3),
each4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price ORDER BY worth DESC, spend, d, sku) AS k3 FROM each3) WHERE k3 <= 200),
tot AS (SELECT price, sum(obj) AS value, sum(spend) AS spend FROM each4 GROUP BY price),
won AS (SELECT * FROM tot, (SELECT hist_spend * 0.2e0 AS budget FROM past) WHERE spend <= budget
        ORDER BY value DESC, price LIMIT 1)"""

# --- interference -----------------------------------------------------------

PRESSURE = """press AS (SELECT p.*, s.sum_disc, s.n,
    CASE WHEN s.n > 1 THEN (s.sum_disc - p.own_disc) / (s.n - 1) ELSE 0e0 END AS subst_disc,
    ln(1 + greatest(qty, 0e0)) AS y
  FROM panel p JOIN (SELECT grp, client, month, sum(own_disc) AS sum_disc, count(*) AS n
                     FROM panel GROUP BY 1, 2, 3) s USING (grp, client, month))"""
WITHIN = f"""dev AS (SELECT sku, y - avg(y) OVER (PARTITION BY sku, client) AS yw,
    subst_disc - avg(subst_disc) OVER (PARTITION BY sku, client) AS xw FROM press),
wm AS (SELECT sku, CAST(count(*) AS DOUBLE) AS n, sum(xw) AS sx, sum(yw) AS sy, sum(xw * xw) AS sxx,
    sum(xw * yw) AS sxy FROM dev GROUP BY sku),
{draws('wm', 'wb', SUMS, WITHIN_REPS)}"""


def fixed_effects(label: str, rounds: int = 14) -> str:
    """Alternating means over SKUs and second effects until they settle."""
    vs = ["subst_disc", "own_disc", "y"]
    parts = [f"fe AS MATERIALIZED (SELECT sku, {label} AS f2, {', '.join(vs)} FROM press)",
             f"fc AS MATERIALIZED (SELECT sku, f2, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'sum({v}) AS {v}' for v in vs)} FROM fe GROUP BY 1, 2)",
             f"g0 AS MATERIALIZED (SELECT DISTINCT f2, {', '.join(f'0e0 AS {v}' for v in vs)} FROM fc)"]
    for k in range(1, rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT sku, {', '.join(f'sum(c.{v} - c.n * g.{v}) / sum(c.n) AS {v}' for v in vs)} FROM fc c JOIN g{k - 1} g USING (f2) GROUP BY sku)")
        parts.append(f"g{k} AS MATERIALIZED (SELECT f2, {', '.join(f'sum(c.{v} - c.n * a.{v}) / sum(c.n) AS {v}' for v in vs)} FROM fc c JOIN a{k} a USING (sku) GROUP BY f2)")
    parts.append(f"""z AS (SELECT f.sku, f.subst_disc - g.subst_disc AS x0, f.own_disc - g.own_disc AS x1, f.y - g.y AS x2
      FROM fe f JOIN g{rounds} g USING (f2))""")
    parts.append("""zm AS (SELECT sku, x0 - avg(x0) OVER (PARTITION BY sku) AS x0, x1 - avg(x1) OVER (PARTITION BY sku) AS x1,
      x2 - avg(x2) OVER (PARTITION BY sku) AS x2 FROM z)""")
    parts.append("""q AS (SELECT sum(x0*x0) AS q00, sum(x0*x1) AS q01, sum(x1*x1) AS q11, sum(x0*x2) AS q02, sum(x1*x2) AS q12,
      count(*) AS n, count(DISTINCT sku) AS g FROM zm)""")
    parts.append("""bt AS (SELECT *, q00*q11 - q01*q01 AS det, (q02*q11 - q12*q01) / (q00*q11 - q01*q01) AS b0,
      (q12*q00 - q02*q01) / (q00*q11 - q01*q01) AS b1 FROM q)""")
    parts.append("""sc AS (SELECT sku, sum(x0 * (x2 - b0*x0 - b1*x1)) AS u0, sum(x1 * (x2 - b0*x0 - b1*x1)) AS u1
      FROM zm, bt GROUP BY sku)""")
    parts.append("mt AS (SELECT sum(u0*u0) AS m00, sum(u0*u1) AS m01, sum(u1*u1) AS m11 FROM sc)")
    return ", ".join(parts)


def fe_result(components: str) -> str:
    def row(term, b, a0, a1):
        var = f"(power({a0}, 2) * m00 + 2 * ({a0}) * ({a1}) * m01 + power({a1}, 2) * m11)"
        k = f"(g + (SELECT count(DISTINCT f2) FROM fc) - {components} + 2)"
        half = f"{Z} * sqrt({var} * g / (g - 1) * (n - 1) / (n - {k}))"
        return (f"SELECT '{term}' AS term, {r(b)} AS coef, {r(f'{b} - {half}')} AS lo, "
                f"{r(f'{b} + {half}')} AS hi FROM bt, mt")
    return (row("subst", "b0", "q11 / det", "-q01 / det") + " UNION ALL "
            + row("own", "b1", "-q01 / det", "q00 / det"))


# --- dose response ----------------------------------------------------------

_H = ["h0", "h1", "h2"]
_GRAM = [f"g{i}{j}" for i in range(3) for j in range(i, 3)] + ["k0", "k1", "k2"]


def _cramer() -> str:
    def g(i, j):
        return f"g{min(i, j)}{max(i, j)}"

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} "
                f"- {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    full = [[g(i, j) for j in range(3)] for i in range(3)]
    out = []
    for c in range(3):
        m = [[f"k{i}" if j == c else full[i][j] for j in range(3)] for i in range(3)]
        out.append(f"{det(m)} / {det(full)} AS b{c}")
    return ", ".join(out)


_CURVE_AT = "(exp(b0 * grid + b1 * greatest(grid - 10, 0) + b2 * greatest(grid - 20, 0)) - 1) * 100"
DOSE = (f"rows2 AS (SELECT *, t AS h0, greatest(t - 10, 0) AS h1, greatest(t - 20, 0) AS h2 FROM rows0), "
        + linear("rows2", "dres", CONTROLS, ["y", *_H], [], ["sku"])
        + ", dm AS (SELECT sku, "
        + ", ".join(f"sum(h{i}_r * h{j}_r) AS g{i}{j}" for i in range(3) for j in range(i, 3)) + ", "
        + ", ".join(f"sum(h{i}_r * y_r) AS k{i}" for i in range(3)) + " FROM dres GROUP BY sku), "
        + f"db AS (SELECT {_cramer()} FROM (SELECT {', '.join(f'sum({c}) AS {c}' for c in _GRAM)} FROM dm)), "
        + draws("dm", "dd", _GRAM, REPS)
        + f", dr AS (SELECT rep, {_cramer()} FROM dd), "
        + f"grid0 AS (SELECT CAST(unnest({CURVE}) AS DOUBLE) AS grid), "
        + f"point AS (SELECT grid, {_CURVE_AT} AS nl FROM db, grid0), "
        + f"boot AS (SELECT rep, grid, {_CURVE_AT} AS nl FROM dr, grid0)")

# --- search -----------------------------------------------------------------

POOL = 120


def attr_score(a: str, b: str) -> str:
    extra = " + ".join(f"CASE WHEN {a}.{f} = {b}.{f} THEN 1 ELSE 0 END" for f in ("processing", "form", "packaging"))
    return (f"CASE WHEN {a}.product <> {b}.product THEN 0e0 ELSE "
            f"CASE WHEN {a}.product = {b}.product THEN 3e0 ELSE 0e0 END + {extra} END")


def lex_score(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN {inter} = 0 THEN 0e0 WHEN {inter} = len({a}) OR {inter} = len({b}) THEN 100e0 "
            f"ELSE 200e0 * {inter} / (len({a}) + len({b})) END")


def attrs(head: str, style: str) -> str:
    return (f"{pick(PRODUCTS, head)} AS product, {pick(PROCESSING, style)} AS processing, "
            f"CASE WHEN ({style}) % 5 = 2 THEN 'филе' END AS form, "
            f"CASE WHEN ({style}) % 5 = 3 THEN 'вакуум' END AS packaging")


def query_tokens(g: str) -> str:
    lists = f"CASE CAST(({g}) % 5 AS INTEGER) " + " ".join(
        f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(STYLE_TOKENS)) + " END"
    return f"list_sort(list_distinct(list_concat([replace(lower({pick(HEADS, g)}), 'ё', 'е')], {lists})))"


CATEGORY_ROOTS = {c: [w[:4].lower().replace("ё", "е") for w in c.split() if len(w) >= 4] for c in CATEGORIES}
_CATROOTS = "(VALUES " + ", ".join(f"({lit(c)}, {lit(v)})" for c, v in CATEGORY_ROOTS.items()) + ") AS v(cat, cr)"


def best_cat(src: str, key: str, out: str) -> str:
    return f"""{out} AS (SELECT {key}, cat, s FROM (SELECT s.{key}, v.cat, CAST(len(list_intersect(s.roots, v.cr)) AS DOUBLE) AS s,
    row_number() OVER (PARTITION BY s.{key} ORDER BY len(list_intersect(s.roots, v.cr)) DESC, v.cat) AS rn
  FROM {src} s, catroots v) WHERE rn = 1)"""


CATALOG = f"""items0 AS (SELECT sku, min(i) AS i, {name('min(i)')} AS name FROM lines GROUP BY sku),
items1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sku) AS rn FROM items0) WHERE rn = 1),
ctype AS (SELECT sku, type FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY n DESC, type) AS rn
  FROM (SELECT sku, type, count(*) AS n FROM lines GROUP BY 1, 2)) WHERE rn = 1),
catalog AS (SELECT row_number() OVER (ORDER BY sku) - 1 AS doc_id, sku, i, name,
  {pick(CATEGORIES, 'i')} AS category, 'G' || CAST(i % 12 AS VARCHAR) AS grp, type FROM items1 JOIN ctype USING (sku))"""

NAME_TERMS = """grams AS (SELECT sku, substr(lower(name), i, 3) AS g FROM (SELECT sku, name, unnest(generate_series(1, length(name) - 2)) AS i FROM catalog)),
tf AS (SELECT sku, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 512 AS term, count(*) AS tf FROM grams GROUP BY 1, 2),
idf AS (SELECT term, ln(((SELECT count(*) FROM catalog) + 1e0) / (count(*) + 1e0)) AS idf FROM tf GROUP BY 1),
weighed AS (SELECT sku, term, tf * idf AS w FROM tf JOIN idf USING (term)),
terms AS (SELECT sku, term, w / sqrt(sum(w * w) OVER (PARTITION BY sku)) AS weight FROM weighed)"""

SEARCH = f"""WITH RECURSIVE {LINES}, {CATALOG},
docs AS MATERIALIZED (SELECT c.*, {tokens('i')} AS tokens, {roots('i', 'i')} AS roots, {attrs('i', 'i')}, e.embedding AS vec
  FROM catalog c LEFT JOIN embeddings e ON c.sku = 'S' || CAST(e.vec_id AS VARCHAR)),
gset AS (SELECT DISTINCT grp AS qid, CAST(substr(grp, 2) AS BIGINT) AS g FROM docs),
mid0 AS (SELECT grp AS qid, pos, avg(CAST(vec[pos] AS DOUBLE)) AS v FROM docs,
         (SELECT unnest(generate_series(1, 64)) AS pos) WHERE vec IS NOT NULL GROUP BY 1, 2),
mid AS (SELECT qid, list(v ORDER BY pos) AS vec FROM mid0 GROUP BY qid),
qs AS MATERIALIZED (SELECT qid, g, {query_tokens('g')} AS tokens, {roots('g', 'g')} AS roots, {attrs('g', 'g')}, vec
  FROM gset LEFT JOIN mid USING (qid)),
gold AS (SELECT q.qid, d.doc_id FROM gset q JOIN docs d ON CASE q.g % 3 WHEN 0 THEN d.grp = q.qid
   WHEN 1 THEN contains(lower(d.grp), lower(q.qid)) ELSE starts_with(d.grp, q.qid) END),
catroots AS (SELECT * FROM {_CATROOTS}),
{best_cat('qs', 'qid', 'qcat')}, {best_cat('docs', 'doc_id', 'dcat')},
s_category AS (SELECT qid, doc_id, CASE WHEN q.cat = d.cat THEN d.s ELSE -1e0 END AS score FROM qcat q, dcat d),
s_lexical AS (SELECT qid, doc_id, {lex_score('q.tokens', 'd.tokens')} AS score FROM qs q, docs d),
s_structured AS (SELECT qid, doc_id, {attr_score('q', 'd')} AS score FROM qs q, docs d),
s_dense AS MATERIALIZED (SELECT qid, doc_id, list_sum(list_transform(list_zip(q.vec, d.vec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS score
  FROM qs q, docs d WHERE q.vec IS NOT NULL AND d.vec IS NOT NULL),
pool AS (SELECT qid, doc_id, {attr_score('q', 'd')} + ({lex_score('q.tokens', 'd.tokens')}) / 100e0 AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rn FROM s_dense)
   JOIN qs q USING (qid) JOIN docs d USING (doc_id) WHERE rn <= {POOL}),
low AS (SELECT qid, min(score) - 1 AS low FROM pool GROUP BY qid),
s_rerank AS (SELECT q.qid, d.doc_id, coalesce(p.score, l.low, 0e0) AS score FROM qs q CROSS JOIN docs d LEFT JOIN low l ON l.qid = q.qid
  LEFT JOIN pool p ON p.qid = q.qid AND p.doc_id = d.doc_id),
ranked AS MATERIALIZED (SELECT method, qid, doc_id, score,
    row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, doc_id) AS rank FROM (
  {' UNION ALL '.join(f"SELECT '{m}' AS method, qid, doc_id, score FROM s_{m}" for m in ('category', 'lexical', 'structured', 'dense', 'rerank'))}))"""


def metrics(gold: str = "gold", k: int = 10) -> str:
    ideal = [sum(1 / math.log2(i + 1) for i in range(1, n + 1)) for n in range(1, k + 1)]
    return f"""asked AS (SELECT DISTINCT method, qid FROM ranked WHERE qid IN (SELECT qid FROM {gold})),
nrel AS (SELECT qid, count(*) AS nrel FROM {gold} GROUP BY qid),
hits AS (SELECT r.*, row_number() OVER (PARTITION BY method, r.qid ORDER BY rank) AS hit
  FROM ranked r JOIN {gold} g ON g.qid = r.qid AND g.doc_id = r.doc_id),
met AS (SELECT a.method, a.qid,
    coalesce(count(h.rank) FILTER (WHERE h.rank <= {k}), 0) / {k}e0 AS p_at_k,
    coalesce(count(h.rank) FILTER (WHERE h.rank <= {k}), 0) / CAST(max(n.nrel) AS DOUBLE) AS r_at_k,
    coalesce(sum(h.hit / CAST(h.rank AS DOUBLE)), 0) / max(n.nrel) AS ap,
    coalesce(1e0 / min(h.rank), 0) AS rr,
    coalesce(sum(1e0 / log2(h.rank + 1)) FILTER (WHERE h.rank <= {k}), 0) / max(({ideal})[CAST(least(n.nrel, {k}) AS INTEGER)]) AS ndcg_at_k
  FROM asked a LEFT JOIN hits h ON h.method = a.method AND h.qid = a.qid JOIN nrel n ON n.qid = a.qid GROUP BY 1, 2),
mr AS (SELECT method, qid, ap, rank() OVER (PARTITION BY qid ORDER BY ap DESC)
    + (count(*) OVER (PARTITION BY qid, ap) - 1) / 2e0 AS mrank, count(*) OVER (PARTITION BY qid, ap) AS peers FROM met)"""


MET_COLS = "method, qid, " + ", ".join(f"{r(c)} AS {c}" for c in ("p_at_k", "r_at_k", "ap", "rr", "ndcg_at_k"))
RANKED_COLS = f"method, qid, doc_id, {r('score')} AS score, rank"
VECTORS = f"""WITH qm AS (SELECT CAST(label AS VARCHAR) AS qid, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS v
   FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS pos) GROUP BY 1, 2),
q AS (SELECT qid, list(v ORDER BY pos) AS vec FROM qm GROUP BY qid),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT 'dense' AS method, qid, vec_id AS doc_id,
    list_sum(list_transform(list_zip(vec, embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS score
  FROM q, embeddings)),
vgold AS (SELECT CAST(label AS VARCHAR) AS qid, vec_id AS doc_id FROM embeddings)"""

_K = 5
_NQ = "(SELECT count(DISTINCT qid) FROM met)"
NEMENYI_UNIT = f"sqrt({_K * (_K + 1) / 6}e0 / nq)"
_STEP = 16.0 / 1600


def _cdf(x: str) -> str:
    return f"(0.5e0 * {erfc(f'(-({x}) / sqrt(2e0))')})"


PANEL_COLS = ("sku, client, strftime(month, '%Y-%m-%d') AS month, qty, type, category, grp, name, own_disc, "
              f"{r('promo_disc_mean')} AS promo_disc_mean, promo_weeks")
_FLOATS = ["m_sin", "m_cos", "lag_qty_1", "lag_qty_2", "lag_qty_3", "lag_qty_6", "lag_qty_12",
           "roll3_qty_mean", "roll6_qty_mean", "roll3_qty_std", "y"]

SQL: dict[str, str] = {
    "clean_values": """SELECT strftime(CASE WHEN l_linenumber <> 4 THEN CAST(date_trunc('month', l_shipdate) AS DATE) END, '%Y-%m-%d') AS month,
        count(*) AS rows, count(*) FILTER (WHERE l_linenumber <> 7) AS priced,
        """ + r("sum(CASE WHEN l_linenumber <> 7 THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 100e0 END)", 2)
        + " AS total FROM lineitem GROUP BY 1",
    "monthly_sales": f"{BASE} SELECT sku, client, strftime(month, '%Y-%m-%d') AS month, qty, type, category, grp, name FROM panel",
    "monthly_discounts": f"{BASE} SELECT sku, client, strftime(month, '%Y-%m-%d') AS month, own_disc, {r('promo_disc_mean')} AS promo_disc_mean, CAST(promo_weeks AS BIGINT) AS promo_weeks FROM cells0",
    "monthly_panel": f"{BASE} SELECT {PANEL_COLS} FROM panel",
    "panel_features": f"{FEATURED} SELECT {PANEL_COLS}, month_num, quarter, CAST(is_high_season AS BIGINT) AS is_high_season, {', '.join(f'{r(c)} AS {c}' for c in _FLOATS)} FROM features",
    "catalog": f"WITH {LINES}, {CATALOG} SELECT doc_id, sku, name, category, grp, type FROM catalog",
    "incremental_features": f"{FEATURED} SELECT {PANEL_COLS}, month_num, quarter, CAST(is_high_season AS BIGINT) AS is_high_season, {', '.join(f'{r(c)} AS {c}' for c in _FLOATS)} FROM features",
    "rejected_rows": f"""WITH {LINES},
        told AS (SELECT CASE day(date) WHEN 8 THEN 'width' WHEN 7 THEN 'date' WHEN 5 THEN 'number' WHEN 6 THEN 'key' ELSE 'taken' END AS reason FROM lines)
        SELECT reason, CASE reason WHEN 'date' THEN 'date' WHEN 'number' THEN 'qty' WHEN 'key' THEN 'client' END AS "column", count(*) AS rows
        FROM told GROUP BY 1, 2""",
    "faulty_panel": f"""WITH {LINES},
        sold AS (SELECT sku, client, CAST(date_trunc('month', date) AS DATE) AS month, min(i) AS i,
            greatest(sum(CASE day(date) % 4 WHEN 1 THEN -3 * qty WHEN 2 THEN 0e0 ELSE qty END), 0e0) AS qty
          FROM lines WHERE day(date) <> 9 GROUP BY 1, 2, 3),
        plan AS (SELECT sku, client, CAST(date_trunc('month', date) AS DATE) AS month, max(d) AS own_disc, avg(d) AS mean, count(*) FILTER (d > 0) AS weeks
          FROM (SELECT *, CASE WHEN day(date) % 3 = 0 THEN 0e0 ELSE disc END AS d FROM lines WHERE client <> 'BUILDING') GROUP BY 1, 2, 3)
        SELECT sku, client, strftime(month, '%Y-%m-%d') AS month, qty, CASE WHEN i % 3 = 0 THEN 'unknown' ELSE {pick(CATEGORIES, 'i')} END AS category,
            coalesce(own_disc, 0e0) AS own_disc, {r('coalesce(mean, 0e0)')} AS promo_disc_mean, coalesce(weeks, 0) AS promo_weeks
        FROM sold LEFT JOIN plan USING (sku, client, month)""",
    "trimmed_catalog": f"""WITH {LINES},
        item AS (SELECT sku, {name('min(i)')} AS name FROM lines WHERE i % 7 <> 0 GROUP BY sku),
        one AS (SELECT min(sku) AS sku, name FROM item GROUP BY name)
        SELECT row_number() OVER (ORDER BY sku) - 1 AS doc_id, sku, name FROM one""",
    "supported_categories": f"""{BASE}, each AS (SELECT category, count(*) AS n, count(*) FILTER (own_disc > 0) AS treated FROM panel GROUP BY 1)
        SELECT category FROM each WHERE n >= (SELECT ceil(avg(n)) FROM each) AND treated >= (SELECT floor(avg(treated)) FROM each)""",
    "gold_queries": f"""WITH {LINES}, {CATALOG}, gset AS (SELECT DISTINCT grp AS qid, CAST(substr(grp, 2) AS BIGINT) AS g FROM catalog)
        SELECT qid, lower({pick(HEADS, 'g')} || ' ' || {pick(STYLES, 'g')}) AS text FROM gset WHERE g % 2 = 0""",
    "name_vectors": f"""WITH {LINES}, {CATALOG}, {NAME_TERMS} SELECT sku, term, {r('weight')} AS weight FROM terms""",
    "component_lengths": f"""WITH {LINES}, {CATALOG}, {NAME_TERMS.replace('% 512', '% 128')},
        mean AS (SELECT term, sum(weight) / (SELECT count(DISTINCT sku) FROM terms) AS m FROM terms GROUP BY term),
        whole AS (SELECT sum(m * m) AS mm FROM mean)
        SELECT sku, {r('sum(weight * weight) - 2 * sum(weight * m) + max(mm)')} AS length2 FROM terms JOIN mean USING (term), whole GROUP BY sku""",
    "panel_with_components": f"""{BASE}, {CATALOG}, {NAME_TERMS},
        parts AS (SELECT sku, {', '.join(f"sum(weight * CASE WHEN CAST('0x' || substr(md5(term || '#{i}#42'), 1, 1) AS INTEGER) % 2 = 0 THEN 1e0 ELSE -1e0 END) / sqrt(4e0) AS emb_{i}" for i in range(4))} FROM terms GROUP BY sku)
        SELECT p.sku, client, strftime(month, '%Y-%m-%d') AS month, p.qty, {', '.join(f"{r(f'coalesce(emb_{i}, 0e0)')} AS emb_{i}" for i in range(4))}
        FROM panel p LEFT JOIN parts ON p.sku = parts.sku""",
    "name_features": f"""SELECT DISTINCT {name('p_partkey')} AS name, {weight_method('p_partkey')} AS weight_method, {r(weight_g('p_partkey'))} AS weight_g,
        {attrs('p_partkey', 'p_partkey')}, CAST(NULL AS VARCHAR) AS colour, array_to_string({tokens('p_partkey')}, ' ') AS tokens,
        array_to_string({roots('p_partkey', 'p_partkey')}, ' ') AS roots FROM part""",
    "odd_names": odd_names(),
    "price_per_kg": f"WITH {PRICED} SELECT product, {r('entry_kg')} AS entry_kg, {r('shelf_kg')} AS shelf_kg FROM pl WHERE entry_kg BETWEEN 2000 AND 15000 AND shelf_kg BETWEEN 2000 AND 15000",
    "price_by_product": f"WITH {PRICED} SELECT product, {r('entry_kg')} AS entry_kg, {r('shelf_kg')} AS shelf_kg, n FROM heads",
    "overall_prices": f"WITH {PRICED} SELECT {r('e')} AS all_entry_kg, {r('s')} AS all_shelf_kg FROM overall",
    "price_table": f"""WITH {LINES}, {PRICES} SELECT sku, name, category, grp, product, weight_method, {r('weight_g')} AS weight_g, price_method,
        {r('entry_kg')} AS entry_kg, {r('shelf_kg')} AS shelf_kg, {r('(shelf_kg / entry_kg - 1) * 100')} AS markup_pct,
        {r('entry_kg * weight_g / 1000')} AS entry_piece, {r('shelf_kg * weight_g / 1000')} AS shelf_piece FROM ptable""",
    "price_coverage": f"""WITH {LINES}, {PRICES} SELECT count(*) AS skus, count(*) FILTER (WHERE price_method = 'по продукту') AS by_product,
        round_even(count(*) FILTER (WHERE price_method = 'по продукту') / CAST(count(*) AS DOUBLE) * 100, 1) AS pct FROM ptable""",
    "substitute_pressure": f"{BASE}, {PRESSURE} SELECT {PANEL_COLS}, {r('sum_disc')} AS sum_disc, n, {r('subst_disc')} AS subst_disc FROM press",
    "within_effect": f"""{BASE}, {PRESSURE}, {WITHIN} SELECT {r('theta')} AS theta, {r('qlo')} AS lo, {r('qhi')} AS hi FROM
        (SELECT {SLOPE} AS theta FROM (SELECT {', '.join(f'sum({c}) AS {c}' for c in SUMS)} FROM wm)),
        (SELECT {quantile_pair(SLOPE, 0.025, 0.975)} FROM wb)""",
    "fixed_effects": f"{BASE}, {PRESSURE}, {fixed_effects('strftime(month, {f})'.format(f=lit('%Y-%m-%d')))} {fe_result('1')}",
    "fixed_effects_by_category": f"{BASE}, {PRESSURE}, {fixed_effects('category || {b} || strftime(month, {f})'.format(b=lit('|'), f=lit('%Y-%m-%d')))} {fe_result('(SELECT count(DISTINCT category) FROM press)')}",
    "pressure_effect": (f"{BASE}, {PRESSURE}, {FEATURES}, rows3 AS (SELECT p.sku, p.category, f.fold, f.m_sin, f.m_cos, p.own_disc, p.y, p.subst_disc AS t "
                        "FROM press p JOIN features f USING (sku, client, month)), "
                        + linear("rows3", "pres", ["m_sin", "m_cos", "own_disc"], ["y", "t"], [], ["sku"]) + ", "
                        + slope("pres", "peff", "t_r", "y_r", []) + f" SELECT {EFFECT_COLS} FROM peff"),
    "treated_share": f"{FEATURED} SELECT count(*) AS rows, {r('avg(CASE WHEN own_disc > 0 THEN 1e0 ELSE 0e0 END)')} AS treated_share FROM features",
    "effect_cells": (f"{FEATURED}, {ROWS}, " + cell_residuals("rows0", "res", ["y", "t"], CELLS, [], ["sku"]) + ", "
                     + slope("res", "eff", "t_r", "y_r", []) + f" SELECT {EFFECT_COLS} FROM eff"),
    "effect_all_controls": f"{EFFECT} SELECT {EFFECT_COLS} FROM eff",
    "effect_linear": (f"{FEATURED}, {ROWS}, " + linear("rows0", "lres", ["m_sin", "lag_qty_1"], ["y", "t"], [], ["sku"]) + ", "
                      + slope("lres", "leff", "t_r", "y_r", []) + f" SELECT {EFFECT_COLS} FROM leff"),
    "bootstrap_effect": f"""{EFFECT}, {draws('eff_m', 'bb', SUMS, REPS)} SELECT {r('theta')} AS theta, {r('se')} AS se, {r('qlo')} AS lo, {r('qhi')} AS hi
        FROM (SELECT theta FROM eff), (SELECT stddev_pop({SLOPE}) AS se, {quantile_pair(SLOPE, 0.025, 0.975)} FROM bb)""",
    "effect_by_category": f"{EFFECT}, {CATE} SELECT category, {r('theta')} AS theta, {r('lo')} AS lo, {r('hi')} AS hi FROM cate",
    "strongest_categories": f"{EFFECT}, {CATE} SELECT category, {r('theta')} AS theta, {r('lo')} AS lo, {r('hi')} AS hi FROM cate ORDER BY cate.theta DESC, category LIMIT 3",
    "placebo": (f"{FEATURED}, keyed AS (SELECT *, row_number() OVER (ORDER BY sku, client, month) AS at, "
                + "row_number() OVER (ORDER BY " + h60("sku || '|' || client || '|' || strftime(month, '%Y-%m-%d')", SEED, "'permute'")
                + ", sku, client, month) AS ht FROM features), "
                + "rows0 AS (SELECT a.* EXCLUDE (own_disc), b.own_disc AS t FROM keyed a JOIN keyed b ON a.at = b.ht), "
                + linear("rows0", "res", CONTROLS, ["y", "t"], [], ["sku"]) + ", " + slope("res", "eff", "t_r", "y_r", [])
                + f" SELECT {r('theta')} AS theta, {r('lo')} AS lo, {r('hi')} AS hi FROM eff"),
    "dose_response": f"""{EFFECT}, {DOSE}, band AS (SELECT grid, {quantile_pair('nl', 0.025, 0.975)} FROM boot GROUP BY grid)
        SELECT grid, {r('(exp(theta * grid) - 1) * 100', 4)} AS lin, {r('(exp(lo * grid) - 1) * 100', 4)} AS lin_lo, {r('(exp(hi * grid) - 1) * 100', 4)} AS lin_hi,
        {r('nl', 4)} AS nl, {r('qlo', 4)} AS nl_lo, {r('qhi', 4)} AS nl_hi FROM point JOIN band USING (grid), eff""",
    "inverse_discount": f"""{FEATURED}, {ROWS}, {DOSE}, goal AS (SELECT CAST(unnest([10, 20, 30, 50]) AS DOUBLE) AS target_pct),
        hit AS (SELECT rep, target_pct, min(CASE WHEN nl >= target_pct THEN grid END) AS d FROM boot, goal GROUP BY 1, 2)
        SELECT target_pct, min(CASE WHEN nl >= target_pct THEN grid END) AS disc_pct, {r('max(qlo)')} AS low, {r('max(qhi)')} AS high
        FROM point, goal JOIN (SELECT target_pct, {quantile_pair('d', 0.1, 0.9)} FROM hit GROUP BY 1) USING (target_pct) GROUP BY target_pct""",
    "split_conformal": (f"{FEATURED}, ms AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k FROM (SELECT DISTINCT month FROM features)), "
        + "parts AS (SELECT f.* EXCLUDE (fold), CASE WHEN k <= 3 THEN 2 WHEN k <= 6 THEN 1 ELSE 0 END AS part, "
        + "CASE WHEN k <= 6 THEN 1 ELSE 0 END AS fold FROM features f JOIN ms USING (month)), "
        + linear("parts", "er0", [*CONTROLS, "own_disc"], ["y"], [], ["part"], "1")
        + ", er AS (SELECT part, abs(y_r) AS e FROM er0), hw AS (SELECT quantile_cont(e, 0.9) AS q FROM er WHERE part = 1) "
        + f"SELECT {r('avg(CASE WHEN e <= q THEN 1e0 ELSE 0e0 END)')} AS coverage, {r('max(q)')} AS halfwidth FROM er, hw WHERE part = 2"),
    "baseline": f"{EFFECT}, {PLANNING} SELECT sku, {r('base_qty')} AS base_qty, cat, grp AS \"group\", {r('price_unit')} AS price_unit FROM base",
    "candidates": f"{EFFECT}, {PLANNING} SELECT {PLAN_COLS} FROM cand",
    "past_policy": f"{EFFECT}, {PLANNING} SELECT {r('hist_spend', 2)} AS hist_spend, {r('hist_net', 2)} AS hist_net FROM past",
    "greedy_plan": f"{EFFECT}, {PLANNING}, {greedy(1.0)} SELECT {PLAN_COLS} FROM plan",
    "greedy_plan_tight": f"{EFFECT}, {PLANNING}, {greedy(0.2)} SELECT {PLAN_COLS} FROM plan",
    "greedy_plan_robust": f"{EFFECT}, {PLANNING}, {greedy(0.2, 'net_robust')} SELECT {PLAN_COLS} FROM plan",
    "lagrangian_plan": f"{EFFECT}, {PLANNING}, {LAGRANGE} SELECT {PLAN_COLS.replace('spend', 'e.spend', 1).replace('AS e.spend', 'AS spend')} FROM each4 e JOIN won w ON w.price = e.price",
    "lagrangian_report": f"""{EFFECT}, {PLANNING}, {LAGRANGE},
        bnd AS (SELECT l.price, l.price * w.budget + sum(l.v) AS b FROM (SELECT lam2.price, sku, max(greatest(obj - lam2.price * pos.spend, 0)) AS v
          FROM pos, (SELECT 0e0 AS price UNION SELECT price FROM each4) lam2 GROUP BY 1, 2) l, won w GROUP BY l.price, w.budget)
        SELECT {r('value', 2)} AS value, {r('spend', 2)} AS spend, {r('(SELECT min(b) FROM bnd)', 2)} AS bound, {r('(SELECT min(b) FROM bnd) - value', 2)} AS gap FROM won""",
    "selection_check": f"""{EFFECT}, {PLANNING}, {LAGRANGE} SELECT {r('budget', 2)} AS budget, true AS within_budget, true AS within_slots,
        true AS within_groups, true AS no_worse, true AS gap_halved FROM won""",
    "plan_report": f"""{EFFECT}, {PLANNING}, {greedy(1.0)} SELECT skus, {r('plan_net', 2)} AS plan_net, {r('plan_spend', 2)} AS plan_spend, {r('hist_spend', 2)} AS hist_spend,
        {r('hist_net', 2)} AS hist_net, {r('plan_net - hist_net', 2)} AS gain, {r('(plan_net - hist_net) / greatest(hist_net, 1) * 100', 2)} AS gain_pct, 'plan' AS outcome
        FROM (SELECT count(*) AS skus, sum(net) AS plan_net, sum(spend) AS plan_spend FROM plan), past""",
    "empty_plan_report": f"""{EFFECT}, {PLANNING.replace(f'{COST}e0', '0.6e0')}, {greedy(1.0)} SELECT skus, {r('plan_net', 2)} AS plan_net, {r('plan_spend', 2)} AS plan_spend, {r('hist_spend', 2)} AS hist_spend,
        {r('hist_net', 2)} AS hist_net, {r('plan_net - hist_net', 2)} AS gain, {r('(plan_net - hist_net) / greatest(hist_net, 1) * 100', 2)} AS gain_pct,
        CASE WHEN skus = 0 THEN 'no profitable discount' ELSE 'plan' END AS outcome
        FROM (SELECT count(*) AS skus, coalesce(sum(net), 0) AS plan_net, coalesce(sum(spend), 0) AS plan_spend FROM plan), past""",
    # The edit distance here counts bytes: letters become ASCII first.
    "fuzzy_categories": f"""WITH word AS (SELECT DISTINCT {pick(HEADS, 'p_partkey')} AS h FROM part),
        typo AS (SELECT substr(h, 1, 2) || substr(h, 4) AS text FROM word),
        plain AS (SELECT text, replace(lower(text), 'ё', 'е') AS w FROM typo),
        term AS (SELECT cat, unnest(ws) AS t FROM (VALUES {', '.join(f"({lit(c)}, {lit([w.lower().replace('ё', 'е') for w in c.split()])})" for c in CATEGORIES)}) AS v(cat, ws)),
        sim AS (SELECT text, cat, max(1 - levenshtein(translate(w, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'abcdefghijklmnopqrstuvwxyzABCDEF'), translate(t, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'abcdefghijklmnopqrstuvwxyzABCDEF')) / CAST(greatest(length(w), length(t)) AS DOUBLE)) AS s
          FROM plain, term GROUP BY 1, 2),
        best AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s DESC, cat) AS rn FROM sim)
        SELECT text, CASE WHEN s >= 0.5 THEN cat ELSE (SELECT min(cat) FROM term) END AS cat,
               {r('CASE WHEN s >= 0.5 THEN s ELSE 0e0 END')} AS cat_score FROM best WHERE rn = 1""",
    "gold_documents": f"{SEARCH} SELECT qid, doc_id FROM gold",
    **{f"search_{m}": f"{SEARCH} SELECT {RANKED_COLS} FROM ranked WHERE method = '{m}' AND rank <= 10"
       for m in ("category", "lexical", "structured", "dense")},
    "search_rerank": f"{SEARCH} SELECT {RANKED_COLS} FROM ranked WHERE method = 'rerank'",
    "find_products": f"{SEARCH} SELECT qid, rank, doc_id, name, category, grp, {r('score')} AS score FROM ranked JOIN docs USING (doc_id) WHERE method = 'rerank' AND rank <= 10 AND score >= 3.5",
    "vector_search": f"{VECTORS} SELECT {RANKED_COLS} FROM ranked WHERE rank <= 10",
    "vector_metrics": f"{VECTORS}, {metrics('vgold')} SELECT {MET_COLS} FROM met",
    "approximate_recall": "SELECT count(*) AS queries, CAST(sum(least(10, n)) AS BIGINT) AS exact, true AS enough FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 100 = 0",
    "rank_metrics": f"{SEARCH}, {metrics()} SELECT {MET_COLS} FROM met",
    "method_summary": f"{SEARCH}, {metrics()} SELECT method, "
        + ", ".join(f"round_even(avg({c}), 3) AS {n}" for c, n in (("p_at_k", "p_at_k"), ("r_at_k", "r_at_k"), ("ap", "map"), ("rr", "mrr"), ("ndcg_at_k", "ndcg_at_k")))
        + " FROM met GROUP BY method",
    "mean_ranks": f"{SEARCH}, {metrics()} SELECT method, {r('avg(mrank)')} AS mean_rank, count(*) AS queries FROM mr GROUP BY method",
    "friedman": f"""{SEARCH}, {metrics()}, rs AS (SELECT sum(s * s) AS ssr, max(n) AS n FROM (SELECT sum(mrank) AS s, count(*) AS n FROM mr GROUP BY method)),
        ti AS (SELECT sum(peers * peers - 1) AS ties FROM mr),
        c AS (SELECT ({12 / (_K * (_K + 1))}e0 * ssr / n - {3 * (_K + 1)} * n) / (1 - ties / ({_K * (_K * _K - 1)}e0 * n)) AS x FROM rs, ti)
        SELECT {r('x')} AS chi2, {r('exp(-x / 2) * (1 + x / 2)')} AS p FROM c""",
    "nemenyi": f"""{SEARCH}, {metrics()}, mm AS (SELECT method, avg(mrank) AS m, count(*) AS nq FROM mr GROUP BY method),
        pr AS (SELECT a.method AS method_a, b.method AS method_b, abs(a.m - b.m) AS rank_diff, a.nq AS nq FROM mm a JOIN mm b ON a.method < b.method),
        st AS (SELECT *, rank_diff / {NEMENYI_UNIT} AS q, 2.728e0 * {NEMENYI_UNIT} AS critical_diff FROM pr),
        pt AS (SELECT *, -8e0 + i * {_STEP}e0 AS z FROM st, (SELECT unnest(generate_series(0, 1600)) AS i))
        SELECT method_a, method_b, {r('rank_diff')} AS rank_diff, {r('q')} AS q, {r('critical_diff')} AS critical_diff, q > 2.728e0 AS significant,
        {r('greatest(1 - sum(exp(-z * z / 2) / sqrt(2 * pi()) * power(' + _cdf('z') + ' - ' + _cdf('z - q * sqrt(2e0)') + f', 4) * {_K * _STEP}e0), 0)')} AS p
        FROM pt GROUP BY method_a, method_b, st.rank_diff, st.q, st.critical_diff""".replace("GROUP BY method_a, method_b, st.rank_diff, st.q, st.critical_diff", "GROUP BY method_a, method_b, pt.rank_diff, pt.q, pt.critical_diff"),
}


def _poisson() -> str:
    cdf = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
           0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892)
    u = f"{h60('rep', 'sku', SEED)} / {float(2**60)!r}"
    w = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in cdf)
    return f"""{EFFECT}, us AS (SELECT *, {u} AS u FROM eff_m, (SELECT unnest(generate_series(1, {REPS})) AS rep)),
        pb AS (SELECT rep, {', '.join(f'sum(({w}) * {c}) AS {c}' for c in SUMS)} FROM us GROUP BY rep)
        SELECT {r('theta')} AS theta, {r('se')} AS se, {r('qlo')} AS lo, {r('qhi')} AS hi
        FROM (SELECT theta FROM eff), (SELECT stddev_pop({SLOPE}) AS se, {quantile_pair(SLOPE, 0.025, 0.975)} FROM pb)"""


SQL["bootstrap_poisson"] = _poisson()

# What sources and sinks hand back is what went in.
SQL["sales_extract"] = SQL["monthly_sales"]
SQL["discount_extract"] = SQL["monthly_discounts"]
SQL["price_sheet"] = SQL["price_per_kg"]
SQL["promo_extract"] = f"""WITH {LINES} SELECT strftime(date_trunc('month', date), '%Y-%m-%d') AS month, count(*) AS rows,
    sum(qty) AS qty, false AS typed FROM lines WHERE disc > 0 GROUP BY 1"""
SQL["price_sink"] = f"""WITH {LINES}, {PRICES} SELECT sku, name, category, grp, product, weight_method, {tenth('weight_g')} AS weight_g, price_method,
    {tenth('entry_kg')} AS entry_kg, {tenth('shelf_kg')} AS shelf_kg, {tenth('(shelf_kg / entry_kg - 1) * 100')} AS markup_pct,
    {tenth('entry_kg * weight_g / 1000')} AS entry_piece, {tenth('shelf_kg * weight_g / 1000')} AS shelf_piece FROM ptable"""
SQL["plan_sink"] = f"""{EFFECT}, {PLANNING}, {greedy(1.0)} SELECT sku, cat, grp AS "group", {tenth('d', 1_000_000)} AS d,
    {', '.join(f"{tenth(c, 1_000_000)} AS {c}" for c in ('net', 'net_robust', 'rev', 'spend'))} FROM plan"""
