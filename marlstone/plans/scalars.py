"""Scalar functions with DuckDB's semantics."""

from __future__ import annotations

from .registry import both

# Strings
both("f1_lower_upper", "SELECT n_nationkey, lower(n_name) AS a, upper(n_name) AS b FROM nation")
both("f2_concat", "SELECT event_id, event_type || '-' || nullif(event_type, 'click') AS a, concat('x', event_type) AS b, concat_ws('/', event_type, 'y', nullif(event_type, 'view')) AS c FROM events")
both("f3_substring", "SELECT n_nationkey, substring(n_name, 2, 3) AS a, substring(n_name, -3, 2) AS b, substring(n_name, 0, 2) AS c, substring(n_name, 4, -2) AS d FROM nation")
both("f4_length", "SELECT doc_id, length(text) AS n, char_length(source) AS m, len(source) AS l, len([doc_id, 2]) AS k, array_length([lang, source, 'x']) AS a FROM documents")
both("f5_bytes_and_codes", "SELECT doc_id, octet_length(encode(text))::BIGINT AS o, bit_length(lang)::BIGINT AS b, ascii(source)::BIGINT AS a, chr(65 + (doc_id % 26)::INT) AS c, levenshtein(source, 'src10')::BIGINT AS l FROM documents")
both("f6_search", "SELECT c_custkey, strpos(c_name, '#') AS p, starts_with(c_name, 'Cus') AS s, ends_with(c_name, '7') AS e, contains(c_name, '00') AS c, contains([c_nationkey, 3], 3) AS l, position('#' IN c_name) AS q FROM customer")
both("f7_shape", "SELECT n_nationkey, replace(n_name, 'A', '__') AS a, repeat(n_name, 2) AS b, reverse(n_name) AS c, trim(concat('  ', n_name, ' ')) AS d, ltrim(concat('  ', n_name)) AS e, rtrim(concat(n_name, '  ')) AS f, left(n_name, 3) AS g, right(n_name, 2) AS h, lpad(n_name, 10, '*') AS i, rpad(n_name, 4, '-') AS j FROM nation")
both("f8_split_part", "SELECT c_custkey, split_part(c_name, '#', 2) AS a, split_part(c_name, '#', 0) AS z, split_part(c_name, '0', -1) AS l FROM customer")
both("f9_string_split", "SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_brand, '') AS b FROM part")
both("f10_regexp_extract", r"SELECT c_custkey, regexp_extract(c_name, '([0-9])([0-9]+)', 2) AS a, regexp_extract(c_name, '([0-9])[0-9]+') AS whole, regexp_extract(c_name, 'x+') AS none, regexp_extract(c_name, 'CUST', 0, 'i') AS i FROM customer")
both("f11_regexp_replace", r"SELECT c_custkey, regexp_replace(c_name, '0', '<z>') AS one, regexp_replace(c_name, '0', 'o', 'g') AS every, regexp_replace(c_name, '([a-z])(#)', '\2\1:') AS back, regexp_replace(c_name, 'CUSTOMER', '$', 'i') AS flag, regexp_replace(c_name, '[a-z]', '', 'ig') AS both_flags FROM customer")
both("f12_regexp_tests", r"SELECT c_custkey, regexp_matches(c_name, '0[1-3]') AS m, regexp_full_match(c_name, 'Customer#[0-9]+') AS f, length(regexp_extract_all(c_name, '0'))::BIGINT AS n FROM customer")
both("f13_printf", "SELECT p_partkey, printf('%05d|%s|%.2f|%x', p_partkey, p_brand, p_retailprice, p_size) AS t, printf('%,d%%', p_partkey * 100000) AS g, printf('%-8d|%+d', p_size, p_size) AS f FROM part")
both("f14_format", "SELECT p_partkey, format('{}@{}', p_name, p_size) AS t, format('{1}-{0}', p_brand, p_partkey) AS places, format('{{{:05d}}} {:.2f}%', p_partkey, p_retailprice) AS spec, format('{:x}', p_partkey) AS h, format('{:>6}|{:<4}|', p_size, p_size) AS wide FROM part")
both("f15_hex", "SELECT n_nationkey, hex(n_nationkey * 1000) AS a, hex(n_name) AS b, decode(from_hex(hex(n_name))) AS c, decode(unhex('6162')) AS d, hex(CAST(n_nationkey AS HUGEINT) * 18446744073709551616) AS w, hex(CAST(-n_nationkey AS HUGEINT)) AS m FROM nation")
both("f16_encode_decode", "SELECT doc_id, decode(encode(text)) AS t FROM documents")
both("f17_typeof", "SELECT event_id, typeof(user_id) AS a, typeof(event_type) AS b, typeof(ts) AS c, typeof([user_id]) AS d, typeof(user_id > 1) AS e, typeof(value) AS f FROM events")
both("f18_error", "SELECT event_id, CASE WHEN event_id < 0 THEN error('below zero') ELSE 'fine' END AS t FROM events")
both("f19_digests", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, sha1(lang) AS o FROM documents")
# Numbers
both("f20_arithmetic", "SELECT event_id, user_id + event_id AS a, user_id - event_id AS b, user_id * event_id AS c, -user_id AS d FROM events")
both("f21_modulo", "SELECT event_id, event_id % nullif(user_id % 4, 0) AS m, -event_id % 7 AS n, value % 2 AS d, 7.5 % (user_id % 2 + 1) AS f, CAST(event_id AS HUGEINT) % 3 AS w FROM events")
both("f22_integer_division", "SELECT event_id, (event_id - 500) // nullif(user_id % 4, 0) AS q, CAST(event_id AS HUGEINT) // 7 AS w, value // 2 AS d FROM events")
both("f23_division", "SELECT event_id, user_id / 7 AS q, event_id / (user_id + 1) AS r, CAST(value AS DECIMAL(18,2)) / 3 AS d, value / (user_id + 1) AS e FROM events")
both("f24_round", "SELECT p_partkey, round(CAST(p_retailprice AS DECIMAL(10,2)), 1) AS a, round(p_size / 4) AS b FROM part")
both("f25_math", "SELECT p_partkey, floor(p_retailprice) AS a, ceil(p_retailprice) AS b, round(sqrt(p_retailprice), 6) AS c, round(exp(p_size / 10), 4) AS d, round(ln(p_retailprice), 6) AS e, round(log10(p_retailprice), 6) AS f, round(power(p_size, 1.5), 4) AS g, abs(25 - p_size) AS h FROM part")
both("f26_sign", "SELECT c_custkey, sign(c_acctbal) AS s, sign(c_nationkey - 3) AS n FROM customer")
both("f28_bits", "SELECT event_id, event_id & 12 AS a, event_id | 3 AS b, xor(event_id, user_id) AS x FROM events")
both("f29_shifts", "SELECT event_id, event_id << 3 AS a, event_id >> 2 AS b FROM events")
both("f30_text_to_number", "SELECT p_partkey, (' ' || p_partkey || '_000 ')::BIGINT AS a, CAST('1e3' AS BIGINT) AS e, CAST('1.5' AS BIGINT) AS r, TRY_CAST(p_name AS BIGINT) AS none, CAST(CAST(p_partkey AS HUGEINT) * 1000000000000000000 AS DOUBLE) AS w FROM part")
# Dates and times
both("f31_to_timestamp", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
both("f32_date_trunc", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('month', ts), '%Y-%m-%d') AS m, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w FROM events")
both("f33_date_parts", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, quarter(ts) AS q, week(ts) AS w, dayofyear(ts) AS doy, dayofweek(ts) AS dow, isodow(ts) AS isodow, epoch(ts) AS e FROM events")
both("f33_extract", "SELECT event_id, extract(epoch FROM ts) AS e, extract(isodow FROM ts) AS i, extract('dow' FROM ts) AS d, date_part('year', ts) AS y, date_part('decade', ts) AS dec, date_part('century', ts) AS c, extract(second FROM ts) AS s, extract(milliseconds FROM ts) AS ms, weekofyear(ts) AS w, dayofmonth(ts) AS dm FROM events")
both("f34_date_diff", "SELECT event_id, date_diff('month', TIMESTAMP '2022-11-15 10:00:00', ts) AS m, date_diff('day', TIMESTAMP '2023-12-31 23:00:00', ts) AS d, datediff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS h, date_diff('year', TIMESTAMP '2020-12-31 00:00:00', ts) AS y, date_diff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS mi, date_diff('second', ts, TIMESTAMP '2024-01-01 00:00:30') AS s, date_diff('quarter', DATE '2020-12-31', CAST(ts AS DATE)) AS q FROM events")
both("f35_strftime", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, strftime(ts, 'day %j, %A %-d %b %y') AS b, strftime(ts, '%I:%M %p') AS c, strftime(ts, '%w%u') AS d FROM events")
both("f37_date_arithmetic", "SELECT event_id, strftime(CAST(ts AS DATE) + 10, '%Y-%m-%d') AS a, strftime(ts + INTERVAL 33 HOURS, '%Y-%m-%d %H:%M:%S') AS b, strftime(ts - INTERVAL 2 MONTHS, '%Y-%m-%d') AS c FROM events")
both("f38_timestamp_text", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS t FROM orders")
# Lists, structs, maps
both("f41_list_index", "SELECT event_id, l[1] AS a, l[-1] AS b, l[9] AS c, l[0] AS z, l[user_id % 5 - 2] AS v, l[2:3] AS s, l[-2:] AS e, event_type[2:3] AS t FROM (SELECT event_id, user_id, event_type, [event_id, user_id, 7] AS l FROM events)")
both("f42_list_transform", "SELECT event_id, list_transform(l, lambda x: x + 1) AS t, list_filter(l, lambda x: x > 50) AS f FROM (SELECT event_id, [event_id, user_id] AS l FROM events)")
both("f43_list_reduce", "SELECT event_id, list_reduce(l, lambda a, x: a * 3 + x) AS r, list_reduce(l, lambda a, x: a + x, 100) AS s FROM (SELECT event_id, [event_id, user_id, 5] AS l FROM events)")
both("f44_list_append", "SELECT event_id, list_append([event_id], user_id) AS a, list_prepend(user_id, [event_id]) AS p FROM events")
both("f45_list_sort", "SELECT event_id, list_sort(l) AS a, list_sort(l, 'DESC', 'NULLS LAST') AS d, list_reverse_sort(l) AS r, list_reverse_sort([event_type, 'm', NULL]) AS t FROM (SELECT event_id, event_type, [user_id % 7, nullif(event_id % 5, 2), 3] AS l FROM events)")
both("f46_list_facts", "SELECT event_id, len(l) AS n, list_position(l, 3) AS p, list_max(l) AS hi, list_min(l) AS lo FROM (SELECT event_id, [user_id % 7, event_id % 5, 3] AS l FROM events)")
both("f47_list_sets", "SELECT event_id, list_sort(list_distinct(l)) AS d, list_contains(l, 4) AS c, list_concat(l, [1]) AS k, flatten([l, l]) AS f FROM (SELECT event_id, [user_id % 7, event_id % 5, 3] AS l FROM events)")
both("f49_structs", "SELECT event_id, s.a AS a, s.b AS b, {'x': user_id, 'y': {'z': event_type}}.y.z AS z, to_json(s)::VARCHAR AS j FROM (SELECT event_id, user_id, event_type, struct_pack(a := user_id, b := event_type) AS s FROM events)")
both("f50_maps", "SELECT event_id, m['t'] AS t, cardinality(m)::BIGINT AS n FROM (SELECT event_id, MAP {'t': event_type, 'u': 'x'} AS m FROM events)")
# JSON
both("f51_json_extract", r"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract('{"a":{"b":[1,2,3]},"s":"x"}', '$.a.b[1]')::VARCHAR AS p, json_extract('{"s":"x"}', '$.s')::VARCHAR AS quoted, ('{"a":{"k":' || event_id || '}}' -> 'a')::VARCHAR AS arrow, json_extract('{"n":null}', '$.n')::VARCHAR AS n, ('[1,2]' -> 1)::VARCHAR AS place FROM events""")
both("f52_json_extract_string", r"""SELECT event_id, json_extract_string(props, '$.k') AS k, props ->> '$.none' AS n, '{"a":{"b":"x"}}' -> 'a' ->> 'b' AS chain, json_extract_string('{"a b":"y"}', '$."a b"') AS quoted FROM events""")
both("f53_json_type", r"""SELECT event_id, json_type(props) AS t, json_type(props, '$.k') AS k, json_type(props, '$.none') AS none, json_type('[1]') AS l, json_type('"x"') AS s, json_type('1.5') AS d, json_type('-1') AS m, json_type('7') AS u, json_type('true') AS b, json_type('{"n":null}', '$.n') AS n FROM events""")
both("f54_from_json", r"""SELECT event_id, (from_json(props, '{"k":"BIGINT"}')).k AS k, from_json('{"n":{"v":"x"},"l":[1,2]}', '{"n":{"v":"VARCHAR"},"l":["INTEGER"]}').n.v AS v FROM events""")
both("f56_try_json", r"""SELECT event_id, TRY(json_extract_string(event_type, '$.a')) AS bad, TRY(json_extract_string(props, '$.k')) AS good, TRY(json_type(event_type)) AS t FROM events""")
both("f55_to_json", "SELECT event_id, to_json({'a': user_id, 'b': nullif(event_type, 'click'), 'c': [1, 2]})::VARCHAR AS j FROM events")
