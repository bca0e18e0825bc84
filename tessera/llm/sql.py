"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str) -> str:
    return f"upper(regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g'))"


_PAIRS = f"""
with held as (
  select distinct {_norm("order_id")} basket, {_norm("item_id")} item from order_items
  where regexp_matches(item_id, '[0-9]') and order_id is not null and {_norm("order_id")} <> ''
), single as (select item, count(*) n from held group by 1), total as (select count(distinct basket) n from held),
pairs as (
  select a.item item_a, b.item item_b, count(*) together from held a join held b on a.basket = b.basket and a.item < b.item group by all
), scored as (
  select item_a, item_b, together, x.n count_a, y.n count_b, t.n baskets
  from pairs join single x on x.item = item_a join single y on y.item = item_b cross join total t
)
"""

SQL = {
    "p2_pairs": _PAIRS
    + """select item_a, item_b, together, count_a, count_b, baskets, round(together::double * baskets / (count_a::double * count_b), 6) lift,
      round(case when together < count_a then (1 - count_b::double / baskets) / (1 - together::double / count_a) end, 6) conviction_ab,
      round(case when together < count_b then (1 - count_a::double / baskets) / (1 - together::double / count_b) end, 6) conviction_ba from scored""",
    "p2_found": _PAIRS + "select item_a, item_b from scored where together >= 5 and together * 1000 >= baskets and together * baskets >= 2.5 * count_a * count_b",
}
