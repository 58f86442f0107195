"""SQL text shared by the checks."""

from __future__ import annotations

SPARSE = """
sparse as (
  select n.n_name store_id, r.r_name state_id, p.p_type item_id,
         case when p.p_type in ('SMALL','MEDIUM','LARGE') then 'SIZE' else 'TIER' end dept_id,
         case when p.p_type in ('SMALL','MEDIUM','LARGE') then 'SIZE' else 'TIER' end cat_id,
         cast(l.l_shipdate as date) date,
         sum(l.l_quantity) sales, round(sum(l.l_extendedprice), 2) / sum(l.l_quantity) sell_price
  from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
  join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
  join part p on l.l_partkey = p.p_partkey group by 1,2,3,4,5,6)"""

WEEKLY = """
weekly as (
  select n.n_name store_id, p.p_type item_id, cast(strftime(date_trunc('week', cast(l.l_shipdate as date)), '%Y%m%d') as int) wm_yr_wk,
         round(sum(l.l_extendedprice), 2) / sum(l.l_quantity) sell_price
  from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
  join nation n on s.s_nationkey = n.n_nationkey
  join part p on l.l_partkey = p.p_partkey group by 1,2,3)"""

CAL = """
cal as (
  select date, 'd_' || cast(datediff('day', date '1995-01-02', date) + 1 as varchar) d,
         cast(strftime(date_trunc('week', date), '%Y%m%d') as int) wm_yr_wk,
         case when month(date)=12 and day(date)=25 then 'Christmas'
              when month(date)=7 and day(date)=4 then 'Independence'
              when month(date)=1 and day(date)=1 then 'NewYear' end event_name_1,
         case when month(date)=12 and day(date)=25 then 'Religious'
              when (month(date)=7 and day(date)=4) or (month(date)=1 and day(date)=1) then 'National' end event_type_1,
         cast(case when day(date) <= 10 then 1 else 0 end as int) snap_CA,
         cast(case when day(date) between 5 and 15 then 1 else 0 end as int) snap_TX,
         cast(case when day(date) % 2 = 0 then 1 else 0 end as int) snap_WI
  from (select cast(unnest(generate_series(date '1995-01-02', date '2001-11-04', interval 1 day)) as date) date))"""

PANEL_ONLY = """
panel as (
  select s.store_id, s.item_id, s.state_id, s.dept_id, s.cat_id, c.date, coalesce(p.sales, 0.0) sales, p.sell_price,
         c.d, c.wm_yr_wk, c.event_name_1, c.event_type_1, c.snap_CA, c.snap_TX, c.snap_WI,
         case when c.date <= date '2001-09-09' then 'train' when c.date <= date '2001-10-07' then 'val'
              when c.date <= date '2001-11-04' then 'test' end split
  from (select distinct store_id, state_id, item_id, dept_id, cat_id from sparse) s cross join cal c
  left join sparse p on p.store_id = s.store_id and p.item_id = s.item_id and p.date = c.date)"""

PANEL = f"with {SPARSE.strip()},{CAL},{PANEL_ONLY}"

FILLED_ONLY = """
carried as (
  select *, last_value(sell_price ignore nulls) over (partition by store_id, item_id order by date
              rows between unbounded preceding and current row) fwd,
            first_value(sell_price ignore nulls) over (partition by store_id, item_id order by date
              rows between unbounded preceding and unbounded following) head
  from panel),
filled as (
  select * exclude (sell_price, fwd, head), coalesce(fwd, head) sell_price,
         coalesce(event_name_1, 'None') event_filled from carried)"""

FILLED = f"{PANEL},{FILLED_ONLY}"


def over_series(frame: str = "") -> str:
    """Window clause of one series in date order."""
    return f"over (partition by store_id, item_id order by date {frame})".replace(" )", ")")
