"""Independent SQL for every registered query, as DuckDB runs it on the same tables.

Written straight from the definitions (window functions, range joins), not from the Spark plans.
"""

from __future__ import annotations

DAY = "cast(cast(l_shipdate as date) + interval '20' year as date)"



def exact_mean(column: str) -> str:
    return f"cast(sum(cast({column} as decimal(27,9))) as double) / count({column})"


def single(column: str) -> str:
    """At single precision, which leaves the last bits of a sum or of an angle out."""
    return f"cast(cast({column} as float) as double)"


LAT, LON, PRICE = exact_mean("latitude"), exact_mean("longitude"), exact_mean("purchase_price")

INPUTS = f"""
sales as (
  select ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber as id,
   'D' || cast(s_nationkey % 5 as varchar) as district_code,
   cast(l_partkey as varchar) || '-' || cast(l_suppkey % 20 as varchar) as property_id,
   '' as property_name, '' as property_unit_number,
   cast(l_linenumber as varchar) as property_house_number,
   p_name as property_street_name, p_brand as property_locality,
   case when s_nationkey % 4 = 3 then null else 2000 + s_nationkey % 4 end as property_post_code,
   l_quantity * 10 as area, 'M' as area_type,
   case when l_linenumber = 6 and l_quantity = 49 then null else {DAY} end as contract_date,
   {DAY} + 42 as settlement_date,
   case when l_linenumber = 7 and l_quantity = 50 then null else l_extendedprice end as purchase_price,
   'R2' as zoning, 'R' as nature_of_property,
   case l_returnflag when 'R' then 'Residence' when 'A' then 'Strata Unit' else 'Commercial' end as primary_purpose,
   case when l_partkey % 11 = 0 then null
     else -34e0 + cast(substr(p_brand,7) as int)*0.017e0 + (l_partkey % 10)*0.001e0 end as latitude,
   case when l_partkey % 11 = 0 then null
     else 150.5e0 + ((cast(substr(p_brand,7) as int)*7) % 25)*0.021e0 + (l_partkey % 13)*0.001e0 end as longitude,
   case when l_partkey % 3 = 0 then '/old' end as realestate_url, cast(null as varchar) as domain_url,
   case when l_suppkey % 3 > 0 then cast({DAY} as timestamp) end as listings_last_checked
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
stations as (
  select n_nationkey as idx, n_name as station, -34e0 + n_nationkey*0.017e0 + 0.0005e0 as latitude,
   150.5e0 + ((n_nationkey*7) % 25)*0.021e0 + 0.0005e0 as longitude from nation),
gazetteer as (
  select lower(p_name || ', ' || p_brand) as addr_key, -34e0 + (p_partkey % 100)*0.01e0 as latitude,
   150.5e0 + (p_partkey % 70)*0.01e0 as longitude,
   row_number() over (partition by p_name, p_brand order by p_partkey % 100, p_partkey % 70) as nth
  from part where length(p_name) % 5 <> 0),
cards as (
  select case when p_partkey % 2 = 0 then 'rea' else 'domain' end as portal,
   replace(lower(p_brand || ' park'), ' ', case when p_partkey % 2 = 0 then '+' else '-' end) as slug,
   2000 + p_partkey % 3 as post_code, p_partkey as position,
   upper(cast(1 + p_partkey % 7 as varchar) || ' ' || p_name || ', ' || p_brand) as body,
   case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then 'https://x.example/' || cast(p_partkey as varchar)
     else '/' || cast(p_partkey as varchar) end as href
  from part)"""

GROWTH = """
valid as (select * from sales where contract_date is not null and purchase_price is not null),
placed as (
  select *, row_number() over (partition by property_id order by contract_date, id, purchase_price) as up,
   row_number() over (partition by property_id order by contract_date desc, id desc, purchase_price desc) as down,
   count(*) over (partition by property_id) as n from valid),
spans as (
  select f.property_id, f.purchase_price as first_price, l.purchase_price as last_price,
   (l.contract_date - f.contract_date) / 365.25e0 as years, year(l.contract_date) as last_year,
   f.property_street_name as street_name, f.property_locality as suburb, coalesce(f.property_post_code, 0) as post_code
  from placed f join placed l on f.property_id = l.property_id and f.up = 1 and l.down = 1 where f.n >= 2),
pg as (
  select *, (last_price - first_price) / first_price as total_growth,
   case when years < 0.5e0 then 0e0 else pow(last_price / first_price, 1e0 / years) - 1e0 end as cagr from spans),
calendar as (select cast(unnest(range(2001, 2026)) as int) as year),
street_growth as (
  select street_name, suburb, post_code, year, avg(cagr) as avg_cagr, count(*) as property_count
  from pg join calendar on last_year >= year group by all),
suburb_growth as (
  select suburb, year, avg(cagr) as avg_cagr, count(*) as property_count
  from pg join calendar on last_year >= year group by all),
street_stats as (
  select property_street_name as street_name, property_locality as suburb, property_post_code as post_code,
   count(distinct property_id) as unique_properties, count(id) as total_sales
  from valid where property_post_code is not null group by all),
street_rated as (
  select s.*, a.avg_cagr from street_stats s left join
   (select street_name, suburb, post_code, avg(cagr) as avg_cagr from pg group by all) a
   on s.street_name = a.street_name and s.suburb = a.suburb and s.post_code = a.post_code),
street_summary as (
  select *, case when avg_cagr >= (select quantile_cont(avg_cagr, 0.9) from street_rated) then 1 else 0 end
   as is_top_performer from street_rated),
suburb_rated as (
  select s.*, a.avg_cagr from
   (select property_locality as suburb, count(distinct property_id) as unique_properties, count(id) as total_sales
    from valid group by all) s
   left join (select suburb, avg(cagr) as avg_cagr from pg group by all) a on s.suburb = a.suburb),
suburb_summary as (
  select *, case when avg_cagr >= (select quantile_cont(avg_cagr, 0.9) from suburb_rated) then 1 else 0 end
   as is_top_performer from suburb_rated)"""

SPACE = f"""
suburb_points as (
  select property_locality as suburb, {LAT} as lat, {LON} as lon
  from sales where latitude is not null group by all),
street_points as (
  select property_street_name as street_name, property_locality as suburb, {LAT} as lat, {LON} as lon
  from sales where latitude is not null group by all),
street_first as (
  select * from (select *, row_number() over (partition by street_name, suburb order by post_code) as nth
   from street_summary) where nth = 1)"""

KM = """2 * 6371e0 * atan2(sqrt({a}), sqrt(1e0 - ({a})))"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return KM.format(a=a)


STATIONS = f"""
distances as (
  select s.id, t.idx, t.station, {km('s.latitude', 's.longitude', 't.latitude', 't.longitude')} as dist
  from {{rows}} s, stations t where s.latitude <> 0 and s.longitude <> 0),
closest as (
  select id, arg_min(station, idx) as nearest_station, min(least) as distance_to_station
  from (select *, min(dist) over (partition by id) as least from distances) where dist <= least + 1e-9 group by id)"""

MIRRORED = """
stations as (
  select 2 * n_nationkey + side as idx, n_name || case side when 0 then ' E' else ' W' end as station,
   -34e0 + n_nationkey*0.017e0 as latitude,
   150.5e0 + n_nationkey*0.021e0 + case side when 0 then 0.003e0 else -0.003e0 end as longitude
  from nation, (select unnest([0, 1]) as side)),
between_stations as (
  select c_custkey as id, -34e0 + c_nationkey*0.017e0 + (c_custkey % 7)*0.0001e0 as latitude,
   150.5e0 + c_nationkey*0.021e0 as longitude from customer)"""

MANY = """
stations as (
  select o_orderkey as idx, 'S' || o_orderkey as station, -34e0 + (o_orderkey*7919 % 9973)*0.0001e0 as latitude,
   150.5e0 + (o_orderkey*3571 % 7907)*0.0001e0 as longitude from orders),
spots as (
  select c_custkey as id, case when c_custkey % 50 = 1 then null else -34e0 + (c_custkey*2579 % 6899)*0.00013e0 end as latitude,
   case when c_custkey % 50 = 2 then 0e0 else 150.5e0 + (c_custkey*1999 % 5003)*0.00017e0 end as longitude from customer)"""

SALE_COLUMNS = """id, district_code, property_id, property_name, property_unit_number, property_house_number,
 property_street_name, property_locality, property_post_code, area, area_type, contract_date, settlement_date,
 round(purchase_price, 6) as purchase_price, zoning, nature_of_property, primary_purpose,
 cast(cast(latitude as float) as double) as latitude, cast(cast(longitude as float) as double) as longitude, round(cagr, 6) as cagr,
 round(total_growth, 6) as total_growth, round(years_held, 6) as years_held, nearest_station,
 round(distance_to_station, 6) as distance_to_station, realestate_url, domain_url"""


def with_(*parts: str) -> str:
    return "with " + ",".join(parts)


def sales_list(where: str, skip: int = 0, limit: int = 100) -> str:
    page = f"""
page as (
  select s.*, g.cagr, g.total_growth, g.years as years_held from sales s left join pg g on s.property_id = g.property_id
  where {where} order by contract_date desc nulls last, id limit {limit} offset {skip})"""
    return (with_(INPUTS, GROWTH, page, STATIONS.format(rows="page"))
            + f" select {SALE_COLUMNS} from page left join closest using (id)")


HISTORY = """
history as (
  select s.*, g.cagr, g.total_growth, g.years as years_held,
   row_number() over (order by contract_date nulls first, s.id) as sale_number
  from sales s left join pg g on s.property_id = g.property_id where s.property_id = '{property_id}')"""


def history(property_id: str) -> str:
    return (with_(INPUTS, GROWTH, HISTORY.format(property_id=property_id), STATIONS.format(rows="history"))
            + f" select sale_number, {SALE_COLUMNS} from history left join closest using (id)")


MONTHLY = f""" select strftime(contract_date, '%Y-%m') as month, cast(cast({PRICE} as float) as double) as avg_price,
 count(id) as count from sales where contract_date is not null {{and_}} group by 1"""

ACTIVE = """ select {select} from sales where year(contract_date) = 2018 {and_}"""

LEADERS = """
growth_suburbs as (select * from suburb_growth where year = 2018 order by avg_cagr desc nulls last, suburb limit 10),
growth_streets as (
  select * from street_growth where year = 2018
  order by avg_cagr desc nulls last, street_name, suburb, post_code limit 10),
active_suburbs as (
  select property_locality as suburb, count(id) as sales_count from sales where year(contract_date) = 2018 {and_}
ORACLE_SQL["ingest_job"] = ORACLE_SQL["ingest_nested_zip"]
ORACLE_SQL["extended_growth"] = ORACLE_SQL["stored_growth"]
ORACLE_SQL["extended_property_growth"] = ORACLE_SQL["property_growth"]
  group by 1 order by 2 desc, 1 limit 10),
active_streets as (
  select property_street_name as street_name, property_locality as suburb, count(id) as sales_count from sales
  where year(contract_date) = 2018 {and_} group by 1, 2 order by 3 desc, 2, 1 limit 10)"""

MAP_SUBURBS = """
leaders as (
  select *, row_number() over (order by avg_cagr desc nulls last, suburb) as rank
  from (select * from suburb_growth where year = 2018) qualify rank <= 10),
targets as (select l.rank, l.suburb, p.lat, p.lon, l.avg_cagr from leaders l join suburb_points p on l.suburb = p.suburb),
near as (
  select t.rank, p.suburb, p.lat, p.lon, row_number() over (partition by t.rank
    order by (p.lat-t.lat)*(p.lat-t.lat) + (p.lon-t.lon)*(p.lon-t.lon), p.suburb) as neighbor_rank
  from targets t join suburb_points p on p.suburb <> t.suburb qualify neighbor_rank <= 5),
rated as (select n.*, s.avg_cagr from near n join suburb_summary s on n.suburb = s.suburb),
map_rows as (
  select t.rank, t.suburb as id, t.suburb as name, cast(cast(t.lat as float) as double) as lat, cast(cast(t.lon as float) as double) as lon,
   round(t.avg_cagr, 6) as cagr, r.neighbor_rank, r.suburb as neighbor_name, cast(cast(r.lat as float) as double) as neighbor_lat,
   cast(cast(r.lon as float) as double) as neighbor_lon, round(r.avg_cagr, 6) as neighbor_cagr
  from targets t left join rated r on t.rank = r.rank)"""

MAP_STREETS = """
leaders as (
  select *, row_number() over (order by avg_cagr desc nulls last, street_name, suburb, post_code) as rank
  from (select * from street_growth where year = 2018) qualify rank <= 10),
targets as (
  select l.rank, l.street_name, l.suburb, p.lat, p.lon, l.avg_cagr
  from leaders l join street_points p on l.suburb = p.suburb and l.street_name = p.street_name),
near as (
  select t.rank, p.street_name, p.suburb, p.lat, p.lon, row_number() over (partition by t.rank
    order by (p.lat-t.lat)*(p.lat-t.lat) + (p.lon-t.lon)*(p.lon-t.lon), p.suburb, p.street_name) as neighbor_rank
  from targets t join street_points p on p.suburb <> t.suburb or p.street_name <> t.street_name
  qualify neighbor_rank <= 5),
rated as (
  select n.*, s.avg_cagr from near n join street_first s on n.suburb = s.suburb and n.street_name = s.street_name),
map_rows as (
  select t.rank, t.street_name || '_' || t.suburb as id, t.street_name || ', ' || t.suburb as name,
   cast(cast(t.lat as float) as double) as lat, cast(cast(t.lon as float) as double) as lon, round(t.avg_cagr, 6) as cagr, r.neighbor_rank,
   r.street_name || ', ' || r.suburb as neighbor_name, cast(cast(r.lat as float) as double) as neighbor_lat,
   cast(cast(r.lon as float) as double) as neighbor_lon, round(r.avg_cagr, 6) as neighbor_cagr
  from targets t left join rated r on t.rank = r.rank)"""

LATEST = """
latest as (
  select * from sales qualify row_number() over (partition by property_id
   order by contract_date desc nulls last, id desc) = 1)"""

MATCHES = """
matches as (
  select s.id, c.portal, c.href, row_number() over (partition by s.id, c.portal order by c.position) as nth
  from {rows} s join cards c on c.post_code = s.property_post_code
   and c.slug = replace(lower(s.property_locality || ' Park'), ' ', case c.portal when 'rea' then '+' else '-' end)
   and contains(lower(c.body), lower(s.property_house_number || ' ' || s.property_street_name))
  where c.href is not null),
links as (
  select id,
   max(case when portal = 'rea' then case when starts_with(href, 'http') then href
     else 'https://www.realestate.com.au' || href end end) as realestate_url,
   max(case when portal = 'domain' then case when starts_with(href, 'http') then href
     else 'https://www.domain.com.au' || href end end) as domain_url
  from matches where nth = 1 group by id)"""

TITLE_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"

DUE = "(listings_last_checked is null or listings_last_checked < timestamp '2019-01-01 00:00:00')"

ORACLE_SQL = {
    "property_growth": with_(INPUTS, GROWTH) + """ select property_id, round(cagr, 6) as cagr,
        round(total_growth, 6) as total_growth, round(years, 6) as years_held,
        round(last_price, 6) as last_sale_price, round(first_price, 6) as first_sale_price from pg""",
    "street_growth": with_(INPUTS, GROWTH) + """ select street_name, suburb, post_code, year,
        round(avg_cagr, 6) as avg_cagr, property_count from street_growth""",
    "suburb_growth": with_(INPUTS, GROWTH) + """ select suburb, year, round(avg_cagr, 6) as avg_cagr, property_count
        from suburb_growth""",
    "street_summary": with_(INPUTS, GROWTH) + """ select street_name, suburb, post_code, unique_properties, total_sales,
        round(avg_cagr, 6) as avg_cagr, is_top_performer from street_summary""",
    "suburb_summary": with_(INPUTS, GROWTH) + """ select suburb, unique_properties, total_sales,
        round(avg_cagr, 6) as avg_cagr, is_top_performer from suburb_summary""",
    "top_decile_threshold": with_(INPUTS, GROWTH) + " select round(quantile_cont(cagr, 0.9), 6) as threshold from pg",

    "sales_list": sales_list("""contract_date >= date '2016-01-01' and contract_date <= date '2019-12-31'
        and primary_purpose = 'Residence' and purchase_price >= 1000 and purchase_price <= 90000
        and area >= 20 and area <= 450"""),
    "sales_list_page": sales_list("true", 40, 60),
    "sales_list_deep": sales_list("true", 40000, 80),
    "sales_list_min_growth": sales_list("g.cagr >= 0.05e0"),
    "sales_list_suburb_ilike": sales_list("property_locality ilike '%bRAND#1_%'"),
    "sales_list_street": sales_list("""year(contract_date) = 2018 and property_locality ilike '%Brand#12%'
        and property_street_name = 'red plate'"""),
    "monthly_price": with_(INPUTS) + MONTHLY.format(and_=""),
    "monthly_price_range": with_(INPUTS) + MONTHLY.format(
        and_="and contract_date >= date '2016-03-10' and contract_date <= date '2018-11-20'"),
    "top_suburbs": with_(INPUTS) + f""" select property_locality as suburb, count(id) as count,
        cast(cast({PRICE} as float) as double) as avg_price from sales
        where contract_date >= date '2016-01-01' and contract_date <= date '2018-12-31'
        group by 1 order by 2 desc, 1 limit 10""",
    "property_history": history("100-18"),
    "property_history_unknown": history("nonexistent_id"),
    "history_links": with_(INPUTS, GROWTH, HISTORY.format(property_id="100-18")) + """ select id,
        coalesce(realestate_url, (select realestate_url from history where sale_number = 1)) as realestate_url,
        coalesce(domain_url, (select domain_url from history where sale_number = 1)) as domain_url from history""",
    "sale_numbers": with_(INPUTS) + """ select id, property_id, row_number() over (partition by property_id
        order by contract_date nulls first, id) as sale_number from sales""",
    "latest_sale": with_(INPUTS, LATEST) + " select property_id, id, contract_date from latest",

    "suburb_cagr": with_(INPUTS, GROWTH) + """ select 'Brand#12' as suburb, 2018 as year, round(avg_cagr, 6) as avg_cagr,
        property_count from suburb_growth where suburb = 'Brand#12' and year = 2018""",
    "suburb_cagr_missing": """ select 'Nowhere' as suburb, 2024 as year, cast(null as double) as avg_cagr,
        cast(0 as bigint) as property_count""",
    "street_cagr": with_(INPUTS, GROWTH) + """ select 'red plate' as street_name, 'Brand#12' as suburb, 2018 as year,
        round(avg(cagr), 6) as avg_cagr, count(*) as property_count from pg
        where street_name = 'red plate' and suburb = 'Brand#12' and last_year >= 2018""",
    "street_trend": with_(INPUTS, GROWTH) + """ select year, round(avg_cagr, 6) as avg_cagr, property_count
        from street_growth where street_name = 'red plate' and suburb = 'Brand#12'""",
    "suburb_trend": with_(INPUTS, GROWTH) + """ select year, round(avg_cagr, 6) as avg_cagr, property_count
        from suburb_growth where suburb = 'Brand#12'""",
    "global_top_suburbs": with_(INPUTS, GROWTH) + """ select suburb, round(avg_cagr, 6) as avg_cagr, unique_properties,
        total_sales from suburb_summary order by suburb_summary.avg_cagr desc nulls last, suburb limit 5""",
    "global_top_streets": with_(INPUTS, GROWTH) + """ select street_name, suburb, round(avg_cagr, 6) as avg_cagr,
        total_sales from street_summary order by street_summary.avg_cagr desc nulls last, street_name, suburb,
        post_code limit 5""",
    "global_summary": with_(INPUTS, GROWTH) + """ select 'suburbs' as list, pos, suburb, cast(null as varchar) as street_name,
        round(avg_cagr, 6) as avg_cagr, unique_properties, total_sales from
         (select *, row_number() over (order by avg_cagr desc nulls last, suburb) as pos from suburb_summary) where pos <= 5
        union all select 'streets', pos, suburb, street_name, round(avg_cagr, 6), null, total_sales from
         (select *, row_number() over (order by avg_cagr desc nulls last, street_name, suburb, post_code) as pos
          from street_summary) where pos <= 5""",
    "top_growth_suburbs": with_(INPUTS, GROWTH, LEADERS.format(and_="")) + """ select suburb,
        round(avg_cagr, 6) as avg_cagr, property_count from growth_suburbs""",
    "top_growth_streets": with_(INPUTS, GROWTH, LEADERS.format(and_="")) + """ select street_name, suburb,
        round(avg_cagr, 6) as avg_cagr, property_count from growth_streets""",
    "activity_suburbs": with_(INPUTS, GROWTH, LEADERS.format(and_="")) + " select * from active_suburbs",
    "activity_streets": with_(INPUTS, GROWTH, LEADERS.format(and_="")) + " select * from active_streets",
    "activity_suburbs_by_type": with_(INPUTS, GROWTH, LEADERS.format(and_="and primary_purpose = 'Strata Unit'"))
        + " select * from active_suburbs",
    "activity_streets_by_type": with_(INPUTS, GROWTH, LEADERS.format(and_="and primary_purpose = 'Strata Unit'"))
        + " select * from active_streets",
    "top_performers": with_(INPUTS, GROWTH, LEADERS.format(and_="and primary_purpose = 'Residence'")) + """
        select 'growth_suburbs' as list, row_number() over (order by avg_cagr desc nulls last, suburb) as pos, suburb,
         cast(null as varchar) as street_name, round(avg_cagr, 6) as avg_cagr, property_count as n from growth_suburbs
        union all select 'growth_streets', row_number() over (order by avg_cagr desc nulls last, street_name, suburb, post_code),
         suburb, street_name, round(avg_cagr, 6), property_count from growth_streets
        union all select 'activity_suburbs', row_number() over (order by sales_count desc, suburb), suburb, null, null, sales_count
         from active_suburbs
        union all select 'activity_streets', row_number() over (order by sales_count desc, suburb, street_name), suburb,
         street_name, null, sales_count from active_streets""",
    "comparison_label": with_(INPUTS, GROWTH, LATEST, """
        by_street as (select street_name, suburb, avg(cagr) as street_avg, count(*) as street_count
          from pg where last_year >= 2018 group by all),
        by_suburb as (select suburb, avg(cagr) as suburb_avg, count(*) as suburb_count
          from pg where last_year >= 2018 group by all),
        compared as (
          select l.property_id, l.property_street_name as street_name, l.property_locality as suburb, g.cagr,
           g.years as years_held, nullif(a.street_avg, 0) as a, nullif(b.suburb_avg, 0) as b, a.street_avg,
           b.suburb_avg, coalesce(a.street_count, 0) as street_count, coalesce(b.suburb_count, 0) as suburb_count
          from latest l left join pg g on l.property_id = g.property_id
          left join by_street a on l.property_street_name = a.street_name and l.property_locality = a.suburb
          left join by_suburb b on l.property_locality = b.suburb)""") + """
        select property_id, street_name, suburb, round(cagr, 6) as cagr, round(years_held, 6) as years_held,
         round(street_avg, 6) as street_avg, street_count, round(suburb_avg, 6) as suburb_avg, suburb_count,
         case when cagr is null or cagr = 0 then 'N/A'
          when cagr > coalesce(a, -1e300) and cagr > coalesce(b, -1e300) then 'Above Average'
          when cagr < coalesce(a, -1e300) and cagr < coalesce(b, -1e300) then 'Below Average'
          else 'Mixed Performance' end as label from compared""",
    "chart_projection": with_(INPUTS, GROWTH, LEADERS.format(and_="")) + """
        (select 'growth_suburbs' as chart, suburb as name, round(avg_cagr * 100, 1) as value, suburb as full_name
         from growth_suburbs order by avg_cagr desc limit 5)
        union all (select 'activity_suburbs', suburb, cast(sales_count as double), suburb from active_suburbs
         order by sales_count desc, suburb limit 5)""",
    "short_prices": with_(INPUTS) + """ select id, case
        when p >= 1000000 then printf('%.1fM', p / 1e6) when p >= 1000 then cast(cast(floor(p / 1e3 + 0.5e0) as bigint) as varchar) || 'K'
        else cast(cast(p as bigint) as varchar) end as short_price,
        greatest(5e0, least(100e0, purchase_price / 1e6 * 800e0)) as bar
        from (select id, floor(purchase_price) as p, purchase_price from sales where purchase_price is not null)""",

    "suburb_centroids": with_(INPUTS, GROWTH, SPACE) + """ select suburb, cast(cast(lat as float) as double) as lat, cast(cast(lon as float) as double) as lon
        from suburb_points""",
    "street_centroids": with_(INPUTS, GROWTH, SPACE) + """ select street_name, suburb, cast(cast(lat as float) as double) as lat,
        cast(cast(lon as float) as double) as lon from street_points""",
    "neighbor_suburbs": with_(INPUTS, GROWTH, SPACE, """
        near as (select p.*, (p.lat-t.lat)*(p.lat-t.lat) + (p.lon-t.lon)*(p.lon-t.lon) as dist
          from suburb_points p, suburb_points t where t.suburb = 'Brand#12' and p.suburb <> 'Brand#12'
          order by dist, p.suburb limit 10)""") + """
        select suburb, cast(cast(lat as float) as double) as latitude, cast(cast(lon as float) as double) as longitude, round(avg_cagr, 6) as avg_cagr,
         total_sales, unique_properties from near join suburb_summary using (suburb)""",
    "neighbor_streets": with_(INPUTS, GROWTH, SPACE, """
        near as (select p.*, (p.lat-t.lat)*(p.lat-t.lat) + (p.lon-t.lon)*(p.lon-t.lon) as dist
          from street_points p, street_points t where t.suburb = 'Brand#12' and t.street_name = 'red plate'
           and (p.suburb <> 'Brand#12' or p.street_name <> 'red plate')
          order by dist, p.suburb, p.street_name limit 20)""") + """
        select street_name, suburb, cast(cast(lat as float) as double) as latitude, cast(cast(lon as float) as double) as longitude,
         round(avg_cagr, 6) as avg_cagr, total_sales from near join street_first using (street_name, suburb)
        order by dist, suburb, street_name limit 15""",
    "neighbor_properties": with_(INPUTS, GROWTH, """
        target as (select latitude, longitude from sales where property_id = '100-18' and latitude is not null
          order by id limit 1)""") + """
        select s.id, s.property_id, property_house_number || ' ' || property_street_name as address,
         property_locality as suburb, cast(cast(s.latitude as float) as double) as latitude, cast(cast(s.longitude as float) as double) as longitude,
         round(cagr, 6) as avg_cagr, round(purchase_price, 6) as last_price
        from sales s join pg on s.property_id = pg.property_id, target t
        where s.property_id <> '100-18' and s.latitude is not null
        order by (s.latitude-t.latitude)*(s.latitude-t.latitude) + (s.longitude-t.longitude)*(s.longitude-t.longitude),
         s.id limit 20""",
    "neighbor_properties_all": with_(INPUTS, GROWTH, """
        cand as (select s.id, s.property_id, s.latitude as lat, s.longitude as lon
          from sales s join pg on s.property_id = pg.property_id where s.latitude is not null),
        most as (select 20 + max(n) as rows from (select count(*) as n from cand group by property_id)),
        tgt as (select property_id, arg_min(latitude, id) as lat, arg_min(longitude, id) as lon
          from sales where latitude is not null group by 1),
        near as (
          select t.lat as tlat, t.lon as tlon, s.lat, s.lon,
           (s.lat-t.lat)*(s.lat-t.lat) + (s.lon-t.lon)*(s.lon-t.lon) as dist,
           rank() over (partition by t.lat, t.lon order by (s.lat-t.lat)*(s.lat-t.lat) + (s.lon-t.lon)*(s.lon-t.lon)) as r
          from (select distinct lat, lon from tgt) t, (select distinct lat, lon from cand) s
          qualify r <= (select rows from most)),
        lists as (
          select n.tlat, n.tlon, c.id, c.property_id as neighbor_property_id, n.dist,
           row_number() over (partition by n.tlat, n.tlon order by n.dist, c.id) as r
          from near n join cand c on n.lat = c.lat and n.lon = c.lon qualify r <= (select rows from most))""") + """
        select t.property_id, row_number() over (partition by t.property_id order by l.dist, l.id) as neighbor_rank,
         l.id, l.neighbor_property_id, l.dist
        from tgt t join lists l on t.lat = l.tlat and t.lon = l.tlon and l.neighbor_property_id <> t.property_id
        qualify neighbor_rank <= 20""",
    "unified_map_suburb": with_(INPUTS, GROWTH, SPACE, MAP_SUBURBS) + " select * from map_rows",
    "unified_map_street": with_(INPUTS, GROWTH, SPACE, MAP_STREETS) + " select * from map_rows",
    "unified_map_clusters": with_(INPUTS, GROWTH, SPACE, MAP_SUBURBS) + """ select rank, id, name, lat, lon, cagr,
        row_number() over (partition by rank order by neighbor_rank) as pos, neighbor_rank, neighbor_name, neighbor_lat,
        neighbor_lon, neighbor_cagr from map_rows""",
    "unified_map_other_level": with_(INPUTS, GROWTH, SPACE, MAP_SUBURBS) + " select * from map_rows where false",
    "nearest_station_ties": with_(MIRRORED, STATIONS.format(rows="between_stations")) + """ select id, nearest_station,
        round(distance_to_station, 6) as distance_to_station from between_stations left join closest using (id)""",
    "nearest_station_large": with_(MANY, STATIONS.format(rows="spots")) + """ select id, nearest_station,
        round(distance_to_station, 6) as distance_to_station from spots left join closest using (id)""",
    "monthly_median_price": with_(INPUTS) + """ select strftime(contract_date, '%Y-%m') as month,
        median(purchase_price) as median_price, count(purchase_price) as count from sales
        where contract_date is not null and purchase_price is not null group by 1""",
    "geocode_by_ids": with_(INPUTS) + """ select id, cast(cast(g.latitude as float) as double) as latitude,
        cast(cast(g.longitude as float) as double) as longitude from sales s
        left join gazetteer g on nth = 1 and addr_key = lower(property_street_name || ', ' || property_locality)
        where s.latitude is null and id % 10 = 3""",
    "enrichment_counts": with_(INPUTS) + """ select count(*) as processed, count(g.latitude) as updated from sales s
        left join gazetteer g on nth = 1 and addr_key = lower(property_street_name || ', ' || property_locality)
        where s.latitude is null""",
    "address_strings": with_(INPUTS) + """ select id,
        property_house_number || ' ' || property_street_name || ', ' || property_locality as local,
        property_house_number || ' ' || property_street_name || ', ' || property_locality || ' NSW'
         || coalesce(' ' || cast(property_post_code as varchar), '') as postal,
        property_house_number || ' ' || property_street_name as street from sales""",
    "nearest_station": with_(INPUTS, STATIONS.format(rows="sales")) + """ select id, nearest_station,
        round(distance_to_station, 6) as distance_to_station from sales left join closest using (id)""",
    "haversine": with_(INPUTS) + f""" select id, round({km('latitude', 'longitude', '-33.8688e0', '151.2093e0')}, 6)
        as km from sales""",

    "ingest_nested_zip": """ select cast(l_partkey as varchar) as property_id, cast(l_linenumber as varchar) as sale_counter,
        cast(l_shipdate as date) as contract_date, l_extendedprice as purchase_price, l_quantity as area,
        'Kent St' as property_street_name from lineitem""",
    "ingest_years": """ select cast(l_partkey as varchar) as property_id, cast(l_linenumber as varchar) as sale_counter,
        cast(l_shipdate as date) as contract_date, l_extendedprice as purchase_price, l_quantity as area,
        'Kent St' as property_street_name from lineitem where year(l_shipdate) between 1993 and 1997""",
    "streamed_growth": """ select 'Sydney' as suburb, count(distinct l_partkey) as unique_properties, count(*) as total_sales from lineitem""",
    "stations_file": with_(INPUTS) + " select cast(idx as int) as idx, station, latitude, longitude from stations",
    "sales_after_build": with_(INPUTS) + """ select count(*) as sales, bit_xor(id) as ids,
        cast(sum(cast(purchase_price as decimal(18,2))) as decimal(38,2)) as paid from sales""",
    "incomplete_addresses": with_(INPUTS, MATCHES.format(rows="(select * from sales where id % 4 > 1)")) + """
        select s.id, k.realestate_url, k.domain_url from sales s left join links k using (id)""",
    "listing_job": with_(INPUTS, MATCHES.replace(" || ' Park'", "").replace("c.slug =", "regexp_replace(c.slug, '.park$', '') =").format(
        rows="(select * from sales where listings_last_checked is null)")) + """
        select s.id, coalesce(k.realestate_url, s.realestate_url) as realestate_url, coalesce(k.domain_url, s.domain_url) as domain_url,
         coalesce(listings_last_checked, timestamp '2019-01-08') as listings_last_checked from sales s left join links k using (id)""",
    "ingest_ids": " select count(*) as sales, count(*) as ids from lineitem",
    "ingest_bad_files": """ select false as damaged, 'broken.zip' as inner, count(distinct (year(l_shipdate), l_orderkey // 20000)) as files
        from lineitem union all select true, null, count(distinct l_orderkey // 20000) from lineitem where year(l_shipdate) = 1995""",
    "sales_with_enrichment": with_(INPUTS, """
        houses as (select lower(cast(1 + p_partkey % 7 as varchar) || ' ' || p_name || ', ' || p_brand) as addr_key,
          arg_min(-34e0 + (p_partkey % 100)*0.01e0, (p_partkey % 100, p_partkey % 70)) as latitude,
          arg_min(150.5e0 + (p_partkey % 70)*0.01e0, (p_partkey % 100, p_partkey % 70)) as longitude from part group by 1)""") + """
        select s.id, cast(cast(coalesce(s.latitude, h.latitude) as float) as double) as latitude,
         cast(cast(case when s.latitude is null and h.latitude is not null then h.longitude else s.longitude end as float) as double) as longitude
        from sales s left join houses h on s.latitude is null and s.id % 10 = 3
         and h.addr_key = lower(property_house_number || ' ' || property_street_name || ', ' || property_locality)""",
    "stored_growth": with_(INPUTS, GROWTH, SPACE) + """ select s.suburb, unique_properties, total_sales, round(avg_cagr, 6) as avg_cagr,
        is_top_performer, y.years, cast(cast(lat as float) as double) as lat, cast(cast(lon as float) as double) as lon
        from suburb_summary s left join suburb_points p on s.suburb = p.suburb
        left join (select suburb, count(*) as years from suburb_growth group by 1) y on s.suburb = y.suburb""",
    "parse_records": f""" select 'D1' as district_code, cast(l_partkey as varchar) as property_id,
        cast(l_linenumber as varchar) as sale_counter, '20240101 00:00' as download_datetime, '' as property_name,
        '' as property_unit_number, '12' as property_house_number, {TITLE_NAME} as property_street_name,
        p_brand as property_locality, cast(2000 + l_linenumber as int) as property_post_code, l_quantity as area,
        'M' as area_type,
        case when l_linenumber <> 6 then cast(l_shipdate as date) end as contract_date,
        cast(null as date) as settlement_date, l_extendedprice as purchase_price, 'R2' as zoning,
        'R' as nature_of_property, 'Residence' as primary_purpose, '' as strata_lot_number, 'AB123' as dealing_number
        from lineitem join part on l_partkey = p_partkey
        where l_linenumber <> 5 and l_suppkey % 17 <> 0 and l_suppkey % 19 <> 0""",
    "title_case": f""" select p_partkey as id, {TITLE_NAME} || '-' || upper(p_type[1]) || lower(p_type[2:]) || ' O''' ||
        {TITLE_NAME} || ' ' || cast(p_size as varchar) || 'St' as name from part""",
    "listing_cards": """ select 'page-' || p_partkey as page_url, case when p_partkey % 2 = 0 then 'rea' else 'domain' end
        as portal, position, case when position = 0 then p_partkey || ' ' || upper(p_name) || ' & CO' else p_type end
        as card_address, case when position = 0 then '/p/' || p_partkey end as href
        from part, (select cast(unnest(range(2)) as int) as position)""",

    "pending_enrich": with_(INPUTS) + """ select id, 'geocoding' as kind from sales where latitude is null
        union all select id, 'listings' from sales where listings_last_checked is null""",
    "geocode_join": with_(INPUTS) + """ select id, cast(cast(g.latitude as float) as double) as latitude, cast(cast(g.longitude as float) as double) as longitude
        from sales s left join gazetteer g on nth = 1 and addr_key = lower(property_street_name || ', ' || property_locality)
        where s.latitude is null""",
    "coordinates_updated": with_(INPUTS) + """ select id, cast(cast(coalesce(s.latitude, g.latitude) as float) as double) as latitude,
        cast(cast(coalesce(s.longitude, g.longitude) as float) as double) as longitude
        from sales s left join gazetteer g on nth = 1 and addr_key = lower(property_street_name || ', ' || property_locality)""",
    "enrich_callback": with_(INPUTS) + """ select count(*) as processed,
        count(*) filter (property_house_number not in ('6', '7')) as updated,
        count(*) filter (property_house_number = '7') as failed from sales where latitude is null""",
    "listing_match": with_(INPUTS, MATCHES.format(rows="sales")) + " select * from links",
    "listing_refresh_due": with_(INPUTS, LATEST) + f" select id, property_id from latest where {DUE}",
    "listing_refresh": with_(INPUTS, LATEST, MATCHES.format(rows="latest")) + f"""
        select id, property_id, k.realestate_url, k.domain_url from latest left join links k using (id) where {DUE}""",

    "cagr_reconcile": with_(INPUTS, GROWTH) + """ select property_id,
        round(case when property_id like '%7' then cagr + 0.001e0 else cagr end, 6) as stored_cagr,
        round(cagr, 6) as computed_cagr, case when property_id like '%7' then 'FAIL' else 'PASS' end as status from pg""",
    "completeness": with_(INPUTS) + """ select count(*) as total, count(*) filter (latitude is null) as missing_coords,
        count(*) filter (listings_last_checked is null) as missing_listings,
        round(100e0 * count(*) filter (latitude is null) / count(*), 1) as missing_coords_pct,
        round(100e0 * count(*) filter (listings_last_checked is null) / count(*), 1) as missing_listings_pct
        from sales""",
    "derived_counts": with_(INPUTS, GROWTH, """
        best as (select * from suburb_summary order by avg_cagr desc nulls last, suburb limit 1)""") + """
        select (select count(*) from street_growth) as street_years, (select count(*) from suburb_growth) as suburb_years,
         (select count(*) from street_summary) as streets, (select count(*) from suburb_summary) as suburbs,
         suburb as top_suburb, round(avg_cagr * 100, 2) as top_avg_cagr_pct, unique_properties as top_properties,
         total_sales as top_sales from best""",
    "coordinate_sample": with_(INPUTS) + """ select id, property_house_number, property_street_name, property_locality,
        cast(cast(latitude as float) as double) as latitude, cast(cast(longitude as float) as double) as longitude from sales where latitude is not null
        order by id limit 5""",
}
ORACLE_SQL["ingest_job"] = ORACLE_SQL["ingest_nested_zip"]
ORACLE_SQL["extended_growth"] = ORACLE_SQL["stored_growth"]
ORACLE_SQL["extended_property_growth"] = ORACLE_SQL["property_growth"]
ORACLE_SQL["compacted_sales"] = ORACLE_SQL["sales_with_enrichment"]
