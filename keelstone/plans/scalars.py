"""Scalar functions over tables of ours, in groups, each beside an expression of the same value in DuckDB's SQL.

An entry is ``alias: (type, Spark, DuckDB)``; with one expression both read it the same.  Types: ``l`` long, ``d`` double
rounded to 6 digits, ``s`` string, ``b`` boolean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelstone.plans.reference import QUERIES, SQL, fresh_name, plain, query
from keelstone.plans import views
from keelstone import catalog

_TYPES = {"l": ("bigint", "bigint"), "d": ("double", "double"), "s": ("string", "varchar"), "b": ("boolean", "boolean")}
_X = "abs(s_acctbal)"
_LIST = "array(p_size, p_size % 7, 3)"
_DUCK_LIST = "[p_size, p_size % 7, 3]"
_TEXT = lambda expression: f"array_join(transform({expression}, x -> cast(x as string)), ',')"
_DUCK_TEXT = lambda expression: f"array_to_string({expression}, ',')"
_MAP = "map('a', p_size, 'b', p_size + 1)"
_XML = "concat('<r><k>', p_size, '</k><k>2</k><t>', p_type, '</t></r>')"
_URL = "concat('https://u@host.org:80/p/', p_partkey, '?q=', p_size, '#f')"

GROUPS: dict[str, tuple[str, str, dict[str, tuple]]] = {
    "scalar_trigonometry": ("supplier", "s_suppkey", {
        "acos": ("d", f"acos({_X} / 20000)"), "acosh": ("d", f"acosh({_X} + 1)"), "asin": ("d", f"asin({_X} / 20000)"), "asinh": ("d", "asinh(s_acctbal)"),
        "atan": ("d", "atan(s_acctbal)"), "atan2": ("d", "atan2(s_acctbal, s_nationkey + 1)"), "atanh": ("d", f"atanh({_X} / 20000)"), "cos": ("d", "cos(s_acctbal)"),
        "cosh": ("d", "cosh(s_acctbal / 10000)"), "cot": ("d", f"cot({_X} / 10000 + 0.5)"), "degrees": ("d", "degrees(s_acctbal / 1000)"), "radians": ("d", "radians(s_acctbal)"),
        "sin": ("d", "sin(s_acctbal)"), "sinh": ("d", "sinh(s_acctbal / 10000)"), "tan": ("d", "tan(s_nationkey)"), "tanh": ("d", "tanh(s_acctbal / 10000)"),
        "hypot": ("d", "hypot(s_acctbal, s_nationkey)", "sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey)"),
    }),
    "scalar_arithmetic": ("supplier", "s_suppkey", {
        "plus": ("l", "s_suppkey + s_nationkey"), "minus": ("l", "s_suppkey - s_nationkey"), "times": ("l", "s_suppkey * s_nationkey"),
        "over": ("d", "s_acctbal / (s_nationkey + 1)"), "div": ("l", "s_suppkey div 7", "s_suppkey // 7"), "rest": ("l", "s_suppkey % 7"),
        "pmod": ("l", "pmod(s_suppkey - 50, 7)", "((s_suppkey - 50) % 7 + 7) % 7"), "unary": ("l", "negative(s_suppkey) + positive(1)", "-s_suppkey + 1"),
        "cbrt": ("d", "cbrt(s_acctbal)"), "exp": ("d", "exp(s_acctbal / 10000)"), "expm1": ("d", "expm1(s_acctbal / 10000)", "exp(s_acctbal / 10000) - 1"),
        "factorial": ("l", "factorial(s_nationkey % 10)"), "ln": ("d", f"ln({_X} + 1)"), "log10": ("d", f"log10({_X} + 1)"),
        "log1p": ("d", f"log1p({_X})", f"ln({_X} + 1)"), "log2": ("d", f"log2({_X} + 1)"), "logb": ("d", f"log(3, {_X} + 2)", f"ln({_X} + 2) / ln(3)"),
        "power": ("d", "power(s_nationkey, 3)"), "rint": ("d", "rint(s_nationkey / 2)", "round_even(s_nationkey / 2, 0)"), "bround": ("d", "bround(s_nationkey / 2, 0)", "round_even(s_nationkey / 2, 0)"),
        "round": ("d", "round(s_acctbal, 1)"), "floor": ("l", "floor(s_acctbal)"), "ceil": ("l", "ceil(s_acctbal)"), "signum": ("d", "signum(s_acctbal)", "sign(s_acctbal)"),
        "bucket": ("l", "width_bucket(s_acctbal, -1000, 10000, 10)", "case when s_acctbal < -1000 then 0 when s_acctbal >= 10000 then 11 else floor((s_acctbal + 1000) / 1100) + 1 end"),
        "greatest": ("l", "greatest(s_suppkey, s_nationkey, 5)"), "least": ("l", "least(s_suppkey, s_nationkey, 5)"), "nan": ("d", "nanvl(if(s_suppkey % 2 = 0, double('NaN'), 1), 7)", "case when s_suppkey % 2 = 0 then 7 else 1 end"),
        "isnan": ("b", "isnan(double('NaN'))", "true"), "rand": ("b", "rand(1) between 0 and 1 and randn(2) < 100", "true"),
    }),
    "scalar_bits_hashes": ("supplier", "s_suppkey", {
        "both": ("l", "s_suppkey & 5"), "either": ("l", "s_suppkey | 5"), "one": ("l", "s_suppkey ^ 5", "xor(s_suppkey, 5::bigint)"), "flipped": ("l", "~s_suppkey"),
        "bits": ("l", "bit_count(s_suppkey)"), "left": ("l", "shiftleft(s_suppkey, 2)", "s_suppkey * 4"), "right": ("l", "shiftright(s_suppkey, 1)", "s_suppkey // 2"),
        "unsigned": ("l", "shiftrightunsigned(s_suppkey, 1)", "s_suppkey // 2"), "bin": ("s", "bin(s_suppkey)"), "conv": ("s", "conv(s_suppkey, 10, 16)", "hex(s_suppkey)"),
        "hex": ("s", "hex(s_name)"), "unhex": ("s", "decode(unhex(hex(s_name)), 'UTF-8')", "s_name"), "md5": ("s", "md5(s_name)"), "sha1": ("s", "sha1(s_name)"), "sha256": ("s", "sha2(s_name, 256)", "sha256(s_name)"),
        "crc32": ("l", "crc32('123456789')", "3421780262"), "base64": ("s", "base64(encode(s_name, 'UTF-8'))", "to_base64(encode(s_name))"), "unbase64": ("s", "decode(unbase64(base64(encode(s_name, 'UTF-8'))), 'UTF-8')", "s_name"),
        "wide": ("s", "hex(encode('a', 'UTF-16BE'))", "'0061'"), "same_hash": ("b", "hash(s_name) = hash(concat(s_name)) and xxhash64(s_name) = xxhash64(concat(s_name))", "true"),
    }),
    "scalar_text": ("part", "p_partkey", {
        "ascii": ("l", "ascii(p_name)"), "bit_length": ("l", "bit_length(p_name)"), "octets": ("l", "octet_length(p_name)", "octet_length(encode(p_name))"), "chr": ("s", "chr(65 + p_size % 26)"),
        "concat": ("s", "concat(p_brand, p_type)"), "joined": ("s", "concat_ws('-', p_brand, p_type)"), "contains": ("b", "contains(p_name, 'a')"), "ends": ("b", "endswith(p_name, 't')", "suffix(p_name, 't')"),
        "starts": ("b", "startswith(p_name, 'c')", "prefix(p_name, 'c')"), "elt": ("s", "elt(1 + p_partkey % 2, p_name, p_brand)", "case when p_partkey % 2 = 0 then p_name else p_brand end"),
        "in_set": ("l", "find_in_set(p_type, 'PROMO,ECONOMY,x')", "coalesce(list_position(['PROMO', 'ECONOMY', 'x'], p_type), 0)"), "number": ("s", "format_number(p_retailprice * 1000, 2)", "format('{:,.2f}', p_retailprice * 1000)"),
        "initcap": ("s", "initcap(p_name)", "list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')"),
        "instr": ("l", "instr(p_name, 'e')"), "locate": ("l", "locate('e', p_name)", "instr(p_name, 'e')"), "left": ("s", "left(p_name, 3)"), "right": ("s", "right(p_name, 3)"), "length": ("l", "length(p_name)"),
        "levenshtein": ("l", "levenshtein(p_name, p_brand)"), "like_all": ("b", "p_name like all ('%a%', '%e%')", "p_name like '%a%' and p_name like '%e%'"), "like_any": ("b", "p_name like any ('%a%', '%e%')", "p_name like '%a%' or p_name like '%e%'"),
        "not_all": ("b", "p_name not like all ('%a%', '%e%')", "p_name not like '%a%' and p_name not like '%e%'"), "not_any": ("b", "p_name not like any ('%a%', '%e%')", "p_name not like '%a%' or p_name not like '%e%'"),
        "rlike": ("b", "p_name rlike '^[a-m]'", "regexp_matches(p_name, '^[a-m]')"), "lower": ("s", "lower(p_type)"), "upper": ("s", "upper(p_name)"), "lpad": ("s", "lpad(p_brand, 12, '*')"), "rpad": ("s", "rpad(p_brand, 12, '*')"),
        "overlay": ("s", "overlay(p_name placing 'XX' from 2 for 3)", "substr(p_name, 1, 1) || 'XX' || substr(p_name, 5)"), "extract": ("s", "regexp_extract(p_brand, '#([0-9]+)', 1)"),
        "all": ("s", "array_join(regexp_extract_all(p_name, '([aeiou])', 1), '')", "array_to_string(regexp_extract_all(p_name, '([aeiou])', 1), '')"), "replaced": ("s", "regexp_replace(p_name, '[aeiou]', '')", "regexp_replace(p_name, '[aeiou]', '', 'g')"),
        "repeat": ("s", "repeat(p_type, 2)"), "replace": ("s", "replace(p_brand, '#', '-')"), "reverse": ("s", "reverse(p_name)"), "words": ("l", "size(sentences(p_name)[0])", "len(string_split(p_name, ' '))"),
        "soundex": ("s", "concat(soundex('Robert'), soundex('Rupert'))", "'R163R163'"), "space": ("s", "concat(space(3), p_type)", "'   ' || p_type"), "split": ("s", "split(p_name, ' ')[0]", "string_split(p_name, ' ')[1]"),
        "substring": ("s", "substring(p_name, 2, 4)"), "index": ("s", "substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"), "translate": ("s", "translate(p_name, 'aeo', '123')"),
        "trim": ("s", "trim(concat('  ', p_type, ' '))", "p_type"), "trim_left": ("s", "ltrim(concat('  ', p_type, ' '))", "p_type || ' '"), "trim_right": ("s", "rtrim(concat('  ', p_type, ' '))", "'  ' || p_type"),
    }),
    "scalar_calendar": ("orders", "o_orderkey", {
        "months": ("s", "add_months(o_orderdate, 2)", "cast(o_orderdate + interval 2 month as date)"), "plus": ("s", "date_add(o_orderdate, 7)", "cast(o_orderdate as date) + 7"), "minus": ("s", "date_sub(o_orderdate, 7)", "cast(o_orderdate as date) - 7"),
        "days": ("l", "datediff(o_orderdate, date'1992-01-01')", "date_diff('day', date '1992-01-01', cast(o_orderdate as date))"), "format": ("s", "date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
        "quarter": ("l", "date_part('quarter', o_orderdate)"), "from_days": ("s", "date_from_unix_date(10000)", "date '1970-01-01' + 10000"), "day": ("l", "dayofmonth(o_orderdate)"), "weekday_1": ("l", "dayofweek(o_orderdate)", "dayofweek(o_orderdate) + 1"),
        "weekday_0": ("l", "weekday(o_orderdate)", "isodow(o_orderdate) - 1"), "year_day": ("l", "dayofyear(o_orderdate)"), "year": ("l", "year(o_orderdate)"), "month": ("l", "month(o_orderdate)"), "week": ("l", "weekofyear(o_orderdate)"),
        "week_year": ("l", "extract(yearofweek from o_orderdate)", "isoyear(o_orderdate)"), "last": ("s", "last_day(o_orderdate)"), "made": ("s", "make_date(year(o_orderdate), 2, 3)"), "made_time": ("s", "cast(make_timestamp_ntz(year(o_orderdate), 2, 3, 4, 5, 6.5) as string)", "make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6.5)"),
        "between": ("d", "months_between(add_months(trunc(o_orderdate, 'MM'), 3), trunc(o_orderdate, 'MM'))", "3"), "next": ("s", "next_day(date'2024-01-01', 'TU')", "date '2024-01-02'"), "trunc": ("s", "trunc(o_orderdate, 'MM')", "cast(date_trunc('month', o_orderdate) as date)"),
        "parsed": ("s", "to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy')", "cast(o_orderdate as date)"), "epoch_day": ("l", "unix_date(to_date(o_orderdate))", "date_diff('day', date '1970-01-01', cast(o_orderdate as date))"),
    }),
    "scalar_times": ("events", "event_id", {
        "hour": ("l", "hour(ts)"), "minute": ("l", "minute(ts)"), "second": ("l", "second(ts)"), "fraction": ("d", "extract(second from ts)", "second(ts) + (microsecond(ts) % 1000000) / 1e6"), "truncated": ("s", "cast(cast(date_trunc('hour', ts) as timestamp_ntz) as string)", "date_trunc('hour', ts)"),
        "later": ("s", "cast(ts + interval 90 minutes as string)", "ts + interval 90 minute"), "earlier": ("s", "cast(ts - interval 3 hours as string)", "ts - interval 3 hour"), "scaled": ("s", "cast(ts + interval 10 minutes * 3 as string)", "ts + interval 30 minute"), "part": ("s", "cast(ts + interval 1 hour / 2 as string)", "ts + interval 30 minute"),
        "seconds": ("l", "unix_seconds(timestamp'2020-01-01 00:00:00Z')", "1577836800"), "millis": ("l", "unix_millis(timestamp_millis(1234567))", "1234567"), "micros": ("l", "unix_micros(timestamp_micros(1234567))", "1234567"), "from_seconds": ("l", "unix_seconds(timestamp_seconds(99))", "99"),
        "there": ("l", "unix_seconds(from_utc_timestamp(timestamp'2020-01-01 00:00:00Z', 'Asia/Tokyo')) - 1577836800", "32400"), "back": ("l", "unix_seconds(to_utc_timestamp(timestamp'2020-01-01 00:00:00Z', 'Asia/Tokyo')) - 1577836800", "-32400"),
        "unix": ("l", "to_unix_timestamp('1970-01-02 00:00:00Z', 'yyyy-MM-dd HH:mm:ssX') + unix_timestamp('1970-01-02 00:00:00Z', 'yyyy-MM-dd HH:mm:ssX')", "172800"), "text": ("s", "date_format(to_timestamp_ntz(from_unixtime(86400 * 400)), 'yyyy')", "'1971'"),
        "passed": ("l", "extract(day from (ts - timestamp_ntz'2023-01-01 00:00:00'))", "date_diff('day', timestamp '2023-01-01 00:00:00', date_trunc('day', ts))"), "hours": ("l", "extract(hour from interval '2 03:04:05' day to second)", "3"), "minutes": ("l", "extract(minute from interval '2 03:04:05' day to second)", "4"),
        "years": ("l", "extract(year from interval '2-7' year to month)", "2"), "months": ("l", "extract(month from interval '2-7' year to month)", "7"), "made": ("s", "cast(timestamp_ntz'2020-01-31 00:00:00' + make_interval(1, 1, 0, 2, 3) as string)", "timestamp '2021-03-02 03:00:00'"),
        "dates": ("l", "extract(day from date'2024-03-01' - date'2024-02-01')", "29"),
    }),
    "scalar_lists": ("part", "p_partkey", {
        "has": ("b", f"array_contains({_LIST}, 3)", f"list_contains({_DUCK_LIST}, 3)"), "distinct": ("s", _TEXT(f"array_sort(array_distinct({_LIST}))"), _DUCK_TEXT(f"list_sort(list_distinct({_DUCK_LIST}))")),
        "except": ("s", _TEXT(f"array_sort(array_except({_LIST}, array(3)))"), _DUCK_TEXT(f"list_sort(list_distinct(list_filter({_DUCK_LIST}, lambda x: x <> 3)))")), "intersect": ("s", _TEXT(f"array_intersect({_LIST}, array(3))"), "'3'"),
        "union": ("s", _TEXT(f"array_sort(array_union({_LIST}, array(9)))"), _DUCK_TEXT(f"list_sort(list_distinct(list_concat({_DUCK_LIST}, [9])))")), "max": ("l", f"array_max({_LIST})", f"list_max({_DUCK_LIST})"), "min": ("l", f"array_min({_LIST})", f"list_min({_DUCK_LIST})"),
        "position": ("l", f"array_position({_LIST}, 3)", f"list_position({_DUCK_LIST}, 3)"), "remove": ("s", _TEXT(f"array_remove({_LIST}, 3)"), _DUCK_TEXT(f"list_filter({_DUCK_LIST}, lambda x: x <> 3)")), "repeat": ("s", _TEXT("array_repeat(p_size, 2)"), _DUCK_TEXT("[p_size, p_size]")),
        "overlap": ("b", f"arrays_overlap({_LIST}, array(1, 2))", f"list_has_any({_DUCK_LIST}, [1, 2])"), "at": ("l", f"element_at({_LIST}, -1)", "3"), "first": ("l", f"{_LIST}[0]", "p_size"), "flatten": ("s", _TEXT(f"flatten(array({_LIST}, array(1)))"), _DUCK_TEXT(f"flatten([{_DUCK_LIST}, [1]])")),
        "backwards": ("s", _TEXT(f"reverse({_LIST})"), _DUCK_TEXT(f"list_reverse({_DUCK_LIST})")), "shuffled": ("l", f"size(shuffle({_LIST}))", "3"), "slice": ("s", _TEXT(f"slice({_LIST}, 2, 2)"), _DUCK_TEXT(f"{_DUCK_LIST}[2:3]")), "sorted": ("s", _TEXT(f"sort_array({_LIST}, false)"), _DUCK_TEXT(f"list_reverse_sort({_DUCK_LIST})")),
        "joined": ("s", _TEXT(f"concat({_LIST}, array(8))"), _DUCK_TEXT(f"list_concat({_DUCK_LIST}, [8])")), "fields": ("s", _TEXT("array(struct(p_size as v), struct(1 as v)).v"), _DUCK_TEXT("[p_size, 1]")), "sum": ("l", f"aggregate({_LIST}, 0, (a, x) -> a + x)", f"list_sum({_DUCK_LIST})"),
        "any": ("b", f"exists({_LIST}, x -> x > 6)", f"len(list_filter({_DUCK_LIST}, lambda x: x > 6)) > 0"), "sequence": ("l", "size(sequence(1, p_size + 1))", "p_size + 1"), "zipped": ("s", _TEXT(f"zip_with({_LIST}, array(1, 2, 3), (a, b) -> a * b)"), _DUCK_TEXT("[p_size, (p_size % 7) * 2, 9]")),
    }),
    "scalar_maps_json_csv": ("part", "p_partkey", {
        "keys": ("s", f"array_join(map_keys({_MAP}), ',')", "'a,b'"), "values": ("s", _TEXT(f"map_values({_MAP})"), _DUCK_TEXT("[p_size, p_size + 1]")), "entries": ("l", f"map_entries({_MAP})[1].value", "p_size + 1"), "from_entries": ("l", f"map_from_entries(map_entries({_MAP}))['a']", "p_size"),
        "from_arrays": ("l", "map_from_arrays(array('x', 'y'), array(1, p_size))['y']", "p_size"), "concat": ("l", f"size(map_concat({_MAP}, map('c', 1)))", "3"), "str_to_map": ("s", "str_to_map(concat('a:', p_type, ',b:2'))['a']", "p_type"), "element": ("l", f"element_at({_MAP}, 'b')", "p_size + 1"), "missing": ("l", f"{_MAP}['zz']", "null"),
        "to_json": ("s", "to_json(named_struct('k', p_size, 't', p_type))", "'{\"k\":' || p_size || ',\"t\":\"' || p_type || '\"}'"), "from_json": ("l", "from_json(to_json(named_struct('k', p_size)), 'k int').k", "p_size"), "json_path": ("s", "get_json_object(to_json(named_struct('a', named_struct('b', p_type))), '$.a.b')", "p_type"),
        "json_keys": ("s", "array_join(json_object_keys('{\"x\": 1, \"y\": 2}'), ',')", "'x,y'"), "json_length": ("l", "json_array_length('[1, 2, 3]')", "3"), "json_schema": ("s", "schema_of_json('{\"x\": 1}')", "'STRUCT<x: BIGINT>'"),
        "to_csv": ("s", "to_csv(named_struct('k', p_size, 't', p_type))", "p_size || ',' || p_type"), "from_csv": ("l", "from_csv(concat(p_size, ',z'), 'k int, t string').k", "p_size"), "csv_schema": ("s", "schema_of_csv('1,a')", "'STRUCT<_c0: INT, _c1: STRING>'"),
    }),
    "scalar_xml_url": ("part", "p_partkey", {
        "long": ("l", f"xpath_long({_XML}, 'sum(r/k)')", "p_size + 2"), "int": ("l", f"xpath_int({_XML}, 'r/k[1]')", "p_size"), "short": ("l", f"xpath_short({_XML}, 'count(r/k)')", "2"), "double": ("d", f"xpath_double({_XML}, 'r/k[1] div 2')", "p_size / 2"), "float": ("d", f"xpath_float({_XML}, 'r/k[2]')", "2"),
        "boolean": ("b", f"xpath_boolean({_XML}, 'r/t')", "true"), "string": ("s", f"xpath_string({_XML}, 'r/t')", "p_type"), "list": ("s", f"array_join(xpath({_XML}, 'r/k/text()'), ',')", "p_size || ',2'"),
        "host": ("s", f"parse_url({_URL}, 'HOST')", "'host.org'"), "path": ("s", f"parse_url({_URL}, 'PATH')", "'/p/' || p_partkey"), "query": ("s", f"parse_url({_URL}, 'QUERY', 'q')", "p_size"), "ref": ("s", f"parse_url({_URL}, 'REF')", "'f'"), "protocol": ("s", f"parse_url({_URL}, 'PROTOCOL')", "'https'"), "user": ("s", f"parse_url({_URL}, 'USERINFO')", "'u'"),
    }),
    "scalar_conditions": ("part", "p_partkey", {
        "case": ("s", "case when p_size > 25 then 'big' when p_size > 10 then 'mid' else 'small' end"), "coalesce": ("l", "coalesce(nullif(p_size, 24), -1)"), "if": ("s", "if(p_size > 25, p_type, p_brand)"), "ifnull": ("l", "ifnull(nullif(p_size, 3), 0)"),
        "nvl": ("l", "nvl(nullif(p_size, 3), 0)", "coalesce(nullif(p_size, 3), 0)"), "nvl2": ("s", "nvl2(nullif(p_size, 3), 'there', 'none')", "case when p_size <> 3 then 'there' else 'none' end"), "is_null": ("b", "isnull(nullif(p_size, 3))", "nullif(p_size, 3) is null"), "is_not_null": ("b", "isnotnull(nullif(p_size, 3))", "nullif(p_size, 3) is not null"),
        "null_safe": ("b", "nullif(p_size, 3) <=> null", "nullif(p_size, 3) is not distinct from null"), "member": ("b", "p_size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)"), "both": ("b", "p_size > 3 and not p_size > 30 or p_type = 'PROMO'"), "typeof": ("s", "typeof(p_size)", "'int'"),
        "asserted": ("b", "assert_true(p_size > -1) is null", "true"), "raised": ("s", "if(p_size < 0, raise_error('negative'), 'fine')", "'fine'"), "order": ("b", "p_size >= 3 and p_size < 40 and p_size <= 50 and p_size <> 7"), "cast": ("d", "cast(cast(p_size as string) as double)"), "field": ("s", "named_struct('a', p_type).a", "p_type"),
    }),
}


def _side(entry: tuple, side: int) -> str:
    kind, *texts = entry
    text = texts[side] if len(texts) > 1 else texts[0]
    cast = f"cast({text} as {_TYPES[kind][side]})"
    return f"round({cast}, 6)" if kind == "d" else cast


def _group(name: str) -> None:
    source, key, entries = GROUPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = plain(spark, sf_dir, source).toDF()
        return rows.selectExpr(key, *[f"{_side(e, 0)} as `{a}`" for a, e in entries.items()])

    run.__name__, run.__doc__ = name, f"Functions over {source}: {', '.join(entries)}."
    QUERIES[name] = run
    SQL[name] = f"select {key}, " + ", ".join(f'{_side(e, 1)} as "{a}"' for a, e in entries.items()) + f" from {source}"


for _name in GROUPS:
    _group(_name)


@query(
    "select p_partkey, cast(pos as bigint) as pos, word, cast(p_size + pos as bigint) as n from (select *, unnest(string_split(p_name, ' ')) as word,"
    " unnest(range(len(string_split(p_name, ' ')))) as pos from part)"
)
def scalar_generators(spark, sf_dir):
    """Explode with and without position, inline and stack; each row of the result comes from all of them."""
    rows = plain(spark, sf_dir, "part").toDF().select("p_partkey", "p_name", "p_size")
    words = rows.selectExpr("p_partkey", "p_size", "posexplode(split(p_name, ' ')) as (pos, word)")
    inlined = words.selectExpr("p_partkey", "word", "inline(array(named_struct('pos', cast(pos as bigint), 'n', cast(p_size + pos as bigint))))")
    stacked = inlined.selectExpr("p_partkey", "word", "pos", "stack(1, n) as n")
    return stacked.selectExpr("p_partkey", "pos", "explode(array(word)) as word", "n").select("p_partkey", "pos", "word", "n")


_VIEWED = [a for a in ("concat", "left", "length", "levenshtein", "lower", "repeat", "replace", "reverse", "substring", "translate", "upper")]


@query("select p_partkey, " + ", ".join(f'{_side(GROUPS["scalar_text"][2][a], 1)} as "{a}"' for a in _VIEWED) + " from part where p_size > 20")
def mv_rewrite_scalars(spark, sf_dir):
    """Functions of the columns of a view that holds the wider range answer a narrower query."""
    name = fresh_name(spark)
    plain(spark, sf_dir, "part", table_name=name)
    from keelstone.session import scratch_path

    views.create_view(spark, fresh_name(spark), scratch_path(spark, "view"), f"select p_partkey, p_name, p_brand, p_type, p_size from keel.{name} where p_size > 10")
    columns = ", ".join(f"{_side(GROUPS['scalar_text'][2][a], 0)} as `{a}`" for a in _VIEWED)
    question = f"select p_partkey, {columns} from keel.{name} where p_size > 20"
    if views.rewritten(spark, question) is None:
        raise RuntimeError("the view should answer the query")
    return catalog.sql(spark, question)
