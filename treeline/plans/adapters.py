"""Projections of the star-schema tables onto manifests, pools, teams, logs and events: the same SQL text for both engines.

A text has {sha:x} for a digest as lower-case hex, {arr:a,b} for an array, and {secs:t} for epoch seconds of a timestamp."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"sha": r"sha2(cast(\1 as string), 256)", "arr": r"array(\1)", "secs": r"unix_timestamp(cast(\1 as timestamp))"}
_DUCK = {"sha": r"sha256(cast(\1 as varchar))", "arr": r"[\1]", "secs": r"cast(floor(epoch(\1)) as bigint)"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _render(text: str, kinds: dict[str, str]) -> str:
    for name, form in kinds.items():
        text = re.sub(r"\{%s:([^{}]*)\}" % name, form, text)
    return text


def duck(text: str) -> str:
    return _render(text, _DUCK)


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the tables it names."""
    text = _render(text, _SPARK)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t in used:
        text = re.sub(rf"\b{t}\b", "{%s}" % t, text)
    return spark.sql(text, **used)


_SIDES = """
select o_custkey as ws, case when o_orderkey % 13 = 0 then '.git/' when o_orderkey % 3 = 0 then 'src/' else '' end
    || case when o_orderkey % 29 = 0 then '.env.' when o_orderkey % 6 = 1 then 'a.b.' else 'f' end || cast(o_orderkey as varchar(20)) as path,
  o_orderkey as k,
  case when o_orderkey % 7 = 0 then 1 when o_orderkey % 35 = 1 then 3 else 0 end as lv,
  case when o_orderkey % 5 = 0 then 2 when o_orderkey % 35 = 1 then 3 else 0 end as rv,
  o_orderkey % 17 <> 3 as bp, o_orderkey % 11 <> 2 and (o_orderkey % 17 <> 3 or o_orderkey % 2 = 0) as lp, o_orderkey % 13 <> 4 as rp
from orders"""


def side(name: str) -> str:
    """One of three manifests: ws, path, size, mode, mtime_secs, mtime_nanos, chunks."""
    v, here, t = {"base": ("0", "bp", "0"), "local": ("lv", "lp", "k % 3"), "remote": ("rv", "rp", "k % 4")}[name]
    return f"""select ws, path, cast({v} + 10 as bigint) as size, cast(420 as int) as mode,
  cast(case when {v} = 0 then 0 else {t} end as bigint) as mtime_secs, cast(0 as bigint) as mtime_nanos, {{arr:{{sha:{v}}}}} as chunks
from ({_SIDES}) s where {here}"""


#: ws, file (key), size, pos, hash: files with ordered chunks; a file without lines is empty.
CHUNKS = """
select o_custkey as ws, o_orderkey as file, {sha:l_partkey} as hash, l_partkey as part_no,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos
from lineitem join orders on l_orderkey = o_orderkey"""
#: Chunks in the pool: those of parts not divisible by 7.
POOL = "select {sha:p_partkey} as hash, cast(p_size as bigint) as length, p_partkey % 1000 as mtime from part where p_partkey % 7 <> 0"
#: The pool and blobs that nothing refers to.
BLOBS = f"{POOL} union all select {{sha:0 - s_suppkey}} as hash, cast(s_suppkey as bigint) as length, s_suppkey * 310 % 1000 as mtime from supplier"
#: Distinct by the part's number, of which the hash is made: a shorter row to deal.
REFS = f"select ws, {{sha:part_no}} as hash from (select distinct ws, part_no from ({CHUNKS}) c) d"
WORKSPACES = "select c_custkey as ws, 'w' || cast(c_custkey % 40 as varchar(20)) as name, case when c_custkey % 10 = 0 then null else c_nationkey end as team, 'u' || cast(c_custkey % 100 as varchar(20)) as owner from customer"
TEAMS = "select n_nationkey as team, n_name as name, n_nationkey % 4 <> 1 as sync_env from nation"
MEMBERS = "select s_nationkey as team, 'u' || cast(s_suppkey as varchar(20)) as user_name, cast(s_suppkey % 3 + 1 as int) as role from supplier"
USERS = "select 'u' || cast(s_suppkey as varchar(20)) as name, case when s_suppkey % 7 = 0 then null else {sha:s_name} end as pubkey, case when s_suppkey % 5 = 0 then null else {sha:s_suppkey} end as key_sig, s_suppkey % 4 <> 0 as sig_valid from supplier"
HEADS = "select o_custkey as ws, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq, o_orderkey as file, o_orderkey % 97 <> 5 as parseable from orders"
SNAPSHOTS = "select user_id as ws, event_id as id, {secs:ts} as created_at, case when event_id % 9 = 0 then 'named' else 'checkpoint' end as kind, event_type as device from events"
EVENTS = "select user_id % 5 as ws, event_id as id, {secs:ts} as seen_at, event_type <> 'view' as wanted from events"
HINTS = "select user_id as ws, event_id as id, event_id % 50 + cast(floor(value) as bigint) % 10 as seq, case when event_id % 10 = 0 then 'other' when event_id % 2 = 0 then 'head_now' else 'head_changed' end as type from events"
PATHS = "select page_id as id, case when page_id % 9 = 0 then '/' else '' end || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || case when page_id % 8 = 1 then '/.env' when page_id % 8 = 2 then '//x' when page_id % 8 = 3 then '/../y' when page_id % 8 = 4 then '/./z' else '' end as path from pages"
