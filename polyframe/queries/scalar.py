"""Scalar functions: math, bits, strings, dates, hashes. One expression a column, beside its SQL."""

from pyspark.sql import functions as F

from .deferred import E
from .registry import family, query

big, text = "CAST({} AS BIGINT)".format, "CAST({} AS VARCHAR)".format
r8 = lambda c: E.round(c, 8)
s8 = "round({}, 8)".format
X = E.col("p_retailprice") / 1000
SX = "(p_retailprice / 1000)"
U = E.col("p_size") / 60
SU = "(p_size / 60)"
K = E.col("p_partkey")

family("math_powers", "part", "p_partkey", {
    "c_sqrt": (r8(E.sqrt(X)), s8(f"sqrt({SX})")),
    "c_cbrt": (r8(E.cbrt(X)), s8(f"cbrt({SX})")),
    "c_exp": (r8(E.exp(X)), s8(f"exp({SX})")),
    "c_expm1": (r8(E.expm1(X)), s8(f"exp({SX}) - 1")),
    "c_ln": (r8(E.ln(X)), s8(f"ln({SX})")),
    "c_log": (r8(E.log(X)), s8(f"ln({SX})")),
    "c_log_base": (r8(E.log(3.0, X)), s8(f"ln({SX}) / ln(3)")),
    "c_log10": (r8(E.log10(X)), s8(f"log10({SX})")),
    "c_log2": (r8(E.log2(X)), s8(f"log2({SX})")),
    "c_log1p": (r8(E.log1p(X)), s8(f"ln(1 + {SX})")),
    "c_pow": (r8(E.pow(X, E.lit(1.5))), s8(f"pow({SX}, 1.5)")),
    "c_power": (r8(E.power(X, 2)), s8(f"pow({SX}, 2)")),
    "c_hypot": (r8(E.hypot(X, U)), s8(f"sqrt({SX} * {SX} + {SU} * {SU})")),
    "c_factorial": (E.factorial(K % 10), big("factorial(CAST(p_partkey % 10 AS INTEGER))")),
    "c_e": (r8(E.e() * X), s8(f"exp(1) * {SX}")),
    "c_pi": (r8(E.pi() * X), s8(f"pi() * {SX}")),
})

family("math_trig", "part", "p_partkey", {
    "c_sin": (r8(E.sin(X)), s8(f"sin({SX})")), "c_cos": (r8(E.cos(X)), s8(f"cos({SX})")), "c_tan": (r8(E.tan(U)), s8(f"tan({SU})")),
    "c_cot": (r8(E.cot(U)), s8(f"1 / tan({SU})")), "c_sec": (r8(E.sec(U)), s8(f"1 / cos({SU})")), "c_csc": (r8(E.csc(U)), s8(f"1 / sin({SU})")),
    "c_asin": (r8(E.asin(U)), s8(f"asin({SU})")), "c_acos": (r8(E.acos(U)), s8(f"acos({SU})")), "c_atan": (r8(E.atan(X)), s8(f"atan({SX})")),
    "c_atan2": (r8(E.atan2(X, U)), s8(f"atan2({SX}, {SU})")),
    "c_sinh": (r8(E.sinh(U)), s8(f"(exp({SU}) - exp(-{SU})) / 2")), "c_cosh": (r8(E.cosh(U)), s8(f"(exp({SU}) + exp(-{SU})) / 2")),
    "c_tanh": (r8(E.tanh(U)), s8(f"(exp({SU}) - exp(-{SU})) / (exp({SU}) + exp(-{SU}))")),
    "c_asinh": (r8(E.asinh(X)), s8(f"ln({SX} + sqrt({SX} * {SX} + 1))")), "c_acosh": (r8(E.acosh(X + 1)), s8(f"ln({SX} + 1 + sqrt(({SX} + 1) * ({SX} + 1) - 1))")),
    "c_atanh": (r8(E.atanh(U)), s8(f"0.5 * ln((1 + {SU}) / (1 - {SU}))")),
    "c_degrees": (r8(E.degrees(U)), s8(f"degrees({SU})")), "c_to_degrees": (r8(E.toDegrees(U)), s8(f"degrees({SU})")),
    "c_radians": (r8(E.radians(X)), s8(f"radians({SX})")), "c_to_radians": (r8(E.toRadians(X)), s8(f"radians({SX})")),
})

family("math_rounding", "part", "p_partkey", {
    "c_abs": (E.abs(K - 50), "abs(p_partkey - 50)"),
    "c_ceil": (E.ceil(X), big(f"ceil({SX})")), "c_ceiling": (E.ceiling(X), big(f"ceil({SX})")), "c_floor": (E.floor(X), big(f"floor({SX})")),
    "c_round": (E.round("p_retailprice"), "round(p_retailprice)"), "c_round1": (E.round("p_retailprice", 1), "round(p_retailprice, 1)"),
    "c_bround": (E.bround(K / 2), "round_even(p_partkey / 2, 0)"), "c_rint": (E.rint(K / 2), "round_even(p_partkey / 2, 0)"),
    "c_signum": (E.signum(K - 50), "CAST(sign(p_partkey - 50) AS DOUBLE)"), "c_sign": (E.sign(K - 50), "CAST(sign(p_partkey - 50) AS DOUBLE)"),
    "c_negative": (E.negative(K), "-p_partkey"), "c_negate": (E.negate(K), "-p_partkey"), "c_positive": (E.positive(K), "p_partkey"),
    "c_pmod": (E.pmod(K - 50, E.lit(7)), "((p_partkey - 50) % 7 + 7) % 7"),
    "c_greatest": (E.greatest("p_size", E.lit(25)), "greatest(p_size, 25)"), "c_least": (E.least("p_size", E.lit(25)), "least(p_size, 25)"),
    "c_width_bucket": (E.width_bucket("p_retailprice", E.lit(900.0), E.lit(2000.0), E.lit(10)), big("CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 11 ELSE floor((p_retailprice - 900) / 110) + 1 END")),
    "c_try_add": (E.try_add(K, E.lit(1)), "p_partkey + 1"), "c_try_subtract": (E.try_subtract(K, E.lit(1)), "p_partkey - 1"),
    "c_try_multiply": (E.try_multiply(K, E.lit(3)), "p_partkey * 3"),
    "c_try_divide": (r8(E.try_divide(E.lit(1), K % 3)), s8("1 / nullif(p_partkey % 3, 0)")), "c_try_mod": (E.try_mod(K, K % 4), "p_partkey % nullif(p_partkey % 4, 0)"),
})

family("math_bits", "part", "p_partkey", {
    "c_and": (K.bitwiseAND(12), "p_partkey & 12"), "c_or": (K.bitwiseOR(12), "p_partkey | 12"), "c_xor": (K.bitwiseXOR(12), "xor(p_partkey, 12)"),
    "c_not": (E.bitwise_not(K), "~p_partkey"), "c_not_old": (E.bitwiseNOT(K), "~p_partkey"),
    "c_left": (E.shiftleft(K, 3), "p_partkey << 3"), "c_left_old": (E.shiftLeft(K, 3), "p_partkey << 3"),
    "c_right": (E.shiftright(K, 2), "p_partkey >> 2"), "c_right_old": (E.shiftRight(K, 2), "p_partkey >> 2"),
    "c_right_unsigned": (E.shiftrightunsigned(K, 2), "p_partkey >> 2"), "c_right_unsigned_old": (E.shiftRightUnsigned(K, 2), "p_partkey >> 2"),
    "c_count": (E.bit_count(K).cast("bigint"), big("bit_count(p_partkey)")),
    "c_get": (E.bit_get(K, E.lit(1)).cast("bigint"), "(p_partkey >> 1) & 1"), "c_getbit": (E.getbit(K, E.lit(0)).cast("bigint"), "p_partkey & 1"),
    "c_bin": (E.bin(K), "bin(p_partkey)"), "c_hex": (E.hex(K), "upper(hex(p_partkey))"),
    "c_conv": (E.conv(K.cast("string"), 10, 16), "upper(hex(p_partkey))"),
    "c_unhex": (E.decode(E.unhex(E.hex("p_brand")), "utf-8"), "p_brand"),
})

P = E.col("o_orderpriority")
family("string_case_pad", "orders", "o_orderkey", {
    "c_upper": (E.upper(P), "upper(o_orderpriority)"), "c_ucase": (E.ucase(P), "upper(o_orderpriority)"), "c_lower": (E.lower(P), "lower(o_orderpriority)"), "c_lcase": (E.lcase(P), "lower(o_orderpriority)"),
    "c_initcap": (E.initcap(E.lit("hello WORLD")), "'Hello World'"),
    "c_trim": (E.trim(E.lit("  a b ")), "trim('  a b ')"), "c_ltrim": (E.ltrim(E.lit("  a ")), "ltrim('  a ')"), "c_rtrim": (E.rtrim(E.lit("  a ")), "rtrim('  a ')"),
    "c_btrim": (E.btrim(P, E.lit("1H")), "trim(o_orderpriority, '1H')"),
    "c_lpad": (E.lpad(P, 12, "*"), "lpad(o_orderpriority, 12, '*')"), "c_rpad": (E.rpad(P, 12, "*"), "rpad(o_orderpriority, 12, '*')"),
    "c_repeat": (E.repeat("o_orderstatus", 3), "repeat(o_orderstatus, 3)"), "c_reverse": (E.reverse(P), "reverse(o_orderpriority)"),
    "c_left": (E.left(P, E.lit(3)), "left(o_orderpriority, 3)"), "c_right": (E.right(P, E.lit(3)), "right(o_orderpriority, 3)"),
    "c_concat": (E.concat(P, E.lit("/"), "o_orderstatus"), "o_orderpriority || '/' || o_orderstatus"),
    "c_concat_ws": (E.concat_ws("-", P, "o_orderstatus"), "concat_ws('-', o_orderpriority, o_orderstatus)"),
    "c_translate": (E.translate(P, "HIG", "hig"), "translate(o_orderpriority, 'HIG', 'hig')"),
    "c_overlay": (E.overlay(P, E.lit("##"), 2, 3), "substr(o_orderpriority, 1, 1) || '##' || substr(o_orderpriority, 5)"),
    "c_replace": (E.replace(P, E.lit("-"), E.lit("+")), "replace(o_orderpriority, '-', '+')"),
})

family("string_search", "orders", "o_orderkey", {
    "c_instr": (E.instr(P, "I").cast("bigint"), big("instr(o_orderpriority, 'I')")),
    "c_locate": (E.locate("I", P).cast("bigint"), big("instr(o_orderpriority, 'I')")), "c_position": (E.position(E.lit("I"), P).cast("bigint"), big("instr(o_orderpriority, 'I')")),
    "c_substring": (E.substring(P, 3, 4), "substr(o_orderpriority, 3, 4)"), "c_substr": (E.substr(P, E.lit(3), E.lit(2)), "substr(o_orderpriority, 3, 2)"),
    "c_substring_index": (E.substring_index(P, "-", 1), "split_part(o_orderpriority, '-', 1)"), "c_split_part": (E.split_part(P, E.lit("-"), E.lit(2)), "split_part(o_orderpriority, '-', 2)"),
    "c_split": (E.array_join(E.split(P, "-"), "|"), "replace(o_orderpriority, '-', '|')"),
    "c_length": (E.length(P).cast("bigint"), big("length(o_orderpriority)")), "c_char_length": (E.char_length(P).cast("bigint"), big("length(o_orderpriority)")), "c_character_length": (E.character_length(P).cast("bigint"), big("length(o_orderpriority)")),
    "c_octets": (E.octet_length(P).cast("bigint"), big("strlen(o_orderpriority)")), "c_bits": (E.bit_length(P).cast("bigint"), big("bit_length(o_orderpriority)")),
    "c_ascii": (E.ascii(P).cast("bigint"), big("ascii(o_orderpriority)")), "c_char": (E.char(E.lit(65)), "chr(65)"), "c_chr": (E.chr(E.lit(66)), "chr(66)"),
    "c_starts": (E.startswith(P, E.lit("1")), "starts_with(o_orderpriority, '1')"), "c_ends": (E.endswith(P, E.lit("H")), "ends_with(o_orderpriority, 'H')"), "c_contains": (E.contains(P, E.lit("IG")), "contains(o_orderpriority, 'IG')"),
    "c_like": (E.like(P, E.lit("%IG%")), "o_orderpriority LIKE '%IG%'"), "c_ilike": (E.ilike(P, E.lit("%ig%")), "o_orderpriority ILIKE '%ig%'"),
    "c_levenshtein": (E.levenshtein(P, E.lit("1-URGENT")).cast("bigint"), big("levenshtein(o_orderpriority, '1-URGENT')")),
    "c_find_in_set": (E.find_in_set("o_orderstatus", E.lit("P,O,F")).cast("bigint"), big("CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 0 END")),
    "c_elt": (E.elt(E.lit(2), E.lit("a"), "o_orderstatus"), "o_orderstatus"),
})

family("string_regex", "customer", "c_custkey", {
    "c_extract": (E.regexp_extract("c_name", r"([A-Za-z]+)#0*([0-9]+)", 2), r"regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2)"),
    "c_replace": (E.regexp_replace("c_name", "0+", "o"), "regexp_replace(c_name, '0+', 'o', 'g')"),
    "c_like": (E.regexp_like("c_name", E.lit("[13]$")), "regexp_matches(c_name, '[13]$')"), "c_rlike": (E.rlike("c_name", E.lit("[13]$")), "regexp_matches(c_name, '[13]$')"), "c_regexp": (E.regexp("c_name", E.lit("[13]$")), "regexp_matches(c_name, '[13]$')"),
    "c_count": (E.regexp_count("c_name", E.lit("0")).cast("bigint"), big("len(regexp_extract_all(c_name, '0'))")),
    "c_all": (E.array_join(E.regexp_extract_all("c_name", E.lit("[1-9]"), E.lit(0)), ","), "array_to_string(regexp_extract_all(c_name, '[1-9]'), ',')"),
    "c_instr": (E.regexp_instr("c_name", E.lit("[0-9]")).cast("bigint"), big("length(regexp_extract(c_name, '^[^0-9]*')) + 1")),
    "c_substr": (E.regexp_substr("c_name", E.lit("[1-9][0-9]*")), "nullif(regexp_extract(c_name, '[1-9][0-9]*'), '')"),
})

family("string_encoding", "customer", "c_custkey", {
    "c_base64": (E.base64(E.encode("c_name", "utf-8")), "base64(encode(c_name))"), "c_unbase64": (E.decode(E.unbase64(E.base64(E.encode("c_name", "utf-8"))), "utf-8"), "c_name"),
    "c_url_encode": (E.url_encode(E.concat("c_name", E.lit(" &"), "c_mktsegment")), "replace(c_name, '#', '%23') || '+%26' || c_mktsegment"), "c_url_decode": (E.url_decode(E.concat("c_mktsegment", E.lit("+%26%23"))), "c_mktsegment || ' &#'"), "c_try_url_decode": (E.try_url_decode(E.concat("c_mktsegment", E.lit("%2F"))), "c_mktsegment || '/'"),
    "c_parse_url": (E.parse_url(E.concat(E.lit("https://h"), "c_custkey", E.lit(".org/p?q=1")), E.lit("HOST")), "'h' || c_custkey || '.org'"), "c_try_parse_url": (E.try_parse_url(E.concat(E.lit("https://x.org/p?q="), "c_custkey"), E.lit("QUERY"), E.lit("q")), "CAST(c_custkey AS VARCHAR)"),
    "c_format_number": (E.format_number(E.col("c_custkey") * 1000.5, 2), "format('{:,.2f}', c_custkey * 1000.5)"), "c_format_string": (E.format_string("%d-%s", "c_custkey", "c_mktsegment"), "c_custkey || '-' || c_mktsegment"), "c_printf": (E.printf(E.lit("%05d"), "c_custkey"), "lpad(CAST(c_custkey AS VARCHAR), greatest(5, length(CAST(c_custkey AS VARCHAR)))::INT, '0')"),
    "c_soundex": (E.soundex(E.lit("Miller")), "'M460'"), "c_mask": (E.mask("c_name"), "regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"), "c_quote": (E.quote("c_name"), "chr(39) || c_name || chr(39)"),
    "c_to_number": (E.to_number(E.lpad(E.col("c_custkey").cast("string"), 9, "0"), E.lit("999999999")).cast("bigint"), "c_custkey"), "c_try_to_number": (E.try_to_number(E.lit("x"), E.lit("999")).cast("bigint"), "NULL::BIGINT"),
    "c_to_char": (E.to_char(E.col("c_custkey") % 900 + 100, E.lit("999")), "CAST(c_custkey % 900 + 100 AS VARCHAR)"), "c_to_varchar": (E.to_varchar(E.lit(78.12), E.lit("99.99")), "'78.12'"),
    "c_to_binary": (E.decode(E.to_binary("c_name", E.lit("utf-8")), "utf-8"), "c_name"), "c_try_to_binary": (E.try_to_binary(E.lit("zz"), E.lit("hex")).isNull(), "true"),
    "c_valid": (E.is_valid_utf8("c_name"), "true"), "c_make_valid": (E.make_valid_utf8("c_name"), "c_name"), "c_validate": (E.validate_utf8("c_name"), "c_name"), "c_try_validate": (E.try_validate_utf8("c_name"), "c_name"),
    "c_sentences": (E.size(E.sentences(E.concat("c_mktsegment", E.lit(" is. Go now.")))).cast("bigint"), "2::BIGINT"),
    "c_collation": (E.collation(E.collate(E.lit("a"), "UTF8_LCASE")).contains("UTF8_LCASE"), "true"),
})

D = E.col("o_orderdate")
family("date_parts", "orders", "o_orderkey", {
    **{f"c_{name}": (getattr(E, name)(D).cast("bigint"), big(f"{sql}(o_orderdate)")) for name, sql in (("year", "year"), ("quarter", "quarter"), ("month", "month"), ("day", "day"), ("dayofmonth", "day"), ("dayofyear", "dayofyear"), ("weekofyear", "weekofyear"), ("hour", "hour"), ("minute", "minute"), ("second", "second"))},
    "c_dayofweek": (E.dayofweek(D).cast("bigint"), big("dayofweek(o_orderdate) + 1")), "c_weekday": (E.weekday(D).cast("bigint"), big("isodow(o_orderdate) - 1")),
    "c_dayname": (E.dayname(D), "left(dayname(o_orderdate), 3)"), "c_monthname": (E.monthname(D), "left(monthname(o_orderdate), 3)"),
    "c_part": (E.date_part(E.lit("YEAR"), D).cast("bigint"), big("year(o_orderdate)")), "c_datepart": (E.datepart(E.lit("MONTH"), D).cast("bigint"), big("month(o_orderdate)")), "c_extract": (E.extract(E.lit("DAY"), D).cast("bigint"), big("day(o_orderdate)")),
})

family("date_arithmetic", "orders", "o_orderkey", {
    "c_add": (E.date_add(D, 10), "CAST(o_orderdate AS DATE) + 10"), "c_dateadd": (E.dateadd(D, 3), "CAST(o_orderdate AS DATE) + 3"), "c_sub": (E.date_sub(D, 10), "CAST(o_orderdate AS DATE) - 10"),
    "c_months": (E.add_months(D, 1), "CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)"),
    "c_diff": (E.datediff(E.lit("2002-01-01").cast("date"), D).cast("bigint"), big("date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')")), "c_date_diff": (E.date_diff(E.lit("2002-01-01").cast("date"), D).cast("bigint"), big("date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')")),
    "c_last_day": (E.last_day(D), "last_day(o_orderdate)"), "c_next_day": (E.next_day(D, "Mon"), "CAST(o_orderdate AS DATE) + CAST((8 - isodow(o_orderdate)) AS INTEGER)"),
    "c_trunc": (E.trunc(D, "month"), "CAST(date_trunc('month', o_orderdate) AS DATE)"), "c_date_trunc": (E.date_trunc("week", D).cast("timestamp_ntz"), "CAST(date_trunc('week', o_orderdate) AS TIMESTAMP)"),
    "c_months_between": (E.months_between(E.trunc(D, "month"), E.lit("1990-03-01").cast("date")), "CAST(date_diff('month', DATE '1990-03-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"),
    "c_months_part": (E.round(E.months_between(E.to_date(D), E.trunc(D, "month")), 8), "CASE WHEN day(o_orderdate) = 1 THEN 0.0::DOUBLE ELSE round((day(o_orderdate) - 1) / 31.0::DOUBLE, 8) END"),
    "c_to_date": (E.to_date(D), "CAST(o_orderdate AS DATE)"), "c_format": (E.date_format(D, "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')"),
    "c_make_date": (E.make_date(E.year(D), E.month(D), E.lit(1)), "make_date(year(o_orderdate), month(o_orderdate), 1)"),
    "c_unix_date": (E.unix_date(E.to_date(D)).cast("bigint"), big("date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))")), "c_from_unix_date": (E.date_from_unix_date(E.unix_date(E.to_date(D))), "CAST(o_orderdate AS DATE)"),
    "c_try_to_date": (E.try_to_date(E.lit("nothing")).isNull(), "true"),
    "c_timestamp_add": (E.timestamp_add("HOUR", E.lit(5), D).cast("timestamp_ntz"), "CAST(o_orderdate + INTERVAL 5 HOUR AS TIMESTAMP)"), "c_timestamp_diff": (E.timestamp_diff("DAY", D, E.lit("2002-01-01").cast("timestamp_ntz")), big("date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')")),
})

T = E.col("ts")
family("time_conversions", "events", "event_id", {
    "c_unix": (E.unix_timestamp(T), big("floor(epoch(ts))")), "c_to_unix": (E.to_unix_timestamp(T), big("floor(epoch(ts))")),
    "c_seconds": (E.unix_seconds(T.cast("timestamp")), big("floor(epoch(ts))")), "c_millis": (E.unix_millis(T.cast("timestamp")), big("floor(epoch_us(ts) / 1000)")), "c_micros": (E.unix_micros(T.cast("timestamp")), "epoch_us(ts)"),
    "c_from_unix": (E.from_unixtime(E.unix_timestamp(T), "yyyy-MM-dd HH:mm:ss"), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "c_to_timestamp": (E.to_timestamp(E.lit("2024-02-03 04:05:06")).cast("timestamp_ntz"), "TIMESTAMP '2024-02-03 04:05:06'"), "c_to_ntz": (E.to_timestamp_ntz(E.lit("2024-02-03 04:05:06")), "TIMESTAMP '2024-02-03 04:05:06'"), "c_to_ltz": (E.to_timestamp_ltz(E.lit("2024-02-03 04:05:06")).cast("timestamp_ntz"), "TIMESTAMP '2024-02-03 04:05:06'"),
    "c_try_to_timestamp": (E.try_to_timestamp(E.lit("x")).isNull(), "true"),
    "c_ts_seconds": (E.timestamp_seconds(E.lit(1700000000)).cast("timestamp_ntz"), "TIMESTAMP '2023-11-14 22:13:20'"), "c_ts_millis": (E.timestamp_millis(E.lit(1700000000000)).cast("timestamp_ntz"), "TIMESTAMP '2023-11-14 22:13:20'"), "c_ts_micros": (E.timestamp_micros(E.lit(1700000000000000)).cast("timestamp_ntz"), "TIMESTAMP '2023-11-14 22:13:20'"),
    "c_from_utc": (E.from_utc_timestamp(T, "Asia/Tokyo").cast("timestamp_ntz"), "ts + INTERVAL 9 HOUR"), "c_to_utc": (E.to_utc_timestamp(T, "Asia/Tokyo").cast("timestamp_ntz"), "ts - INTERVAL 9 HOUR"),
    "c_zone": (E.convert_timezone(E.lit("UTC"), E.lit("Asia/Tokyo"), T), "ts + INTERVAL 9 HOUR"),
    "c_make": (E.make_timestamp(E.lit(2024), E.lit(1), E.lit(2), E.lit(3), E.lit(4), E.lit(5.0)).cast("timestamp_ntz"), "TIMESTAMP '2024-01-02 03:04:05'"), "c_make_ntz": (E.make_timestamp_ntz(E.lit(2024), E.lit(1), E.lit(2), E.lit(3), E.lit(4), E.lit(5.0)), "TIMESTAMP '2024-01-02 03:04:05'"), "c_make_ltz": (E.make_timestamp_ltz(E.lit(2024), E.lit(1), E.lit(2), E.lit(3), E.lit(4), E.lit(5.0)).cast("timestamp_ntz"), "TIMESTAMP '2024-01-02 03:04:05'"),
    "c_try_make": (E.try_make_timestamp(E.lit(2024), E.lit(13), E.lit(2), E.lit(3), E.lit(4), E.lit(5.0)).isNull(), "true"), "c_try_make_ntz": (E.try_make_timestamp_ntz(E.lit(2024), E.lit(13), E.lit(2), E.lit(3), E.lit(4), E.lit(5.0)).isNull(), "true"), "c_try_make_ltz": (E.try_make_timestamp_ltz(E.lit(2024), E.lit(13), E.lit(2), E.lit(3), E.lit(4), E.lit(5.0)).isNull(), "true"),
    "c_interval": ((T + E.make_interval(days=E.lit(1), hours=E.lit(2))), "ts + INTERVAL 26 HOUR"), "c_dt_interval": (T + E.make_dt_interval(E.lit(1), E.lit(2)), "ts + INTERVAL 26 HOUR"), "c_ym_interval": (T + E.make_ym_interval(E.lit(1), E.lit(1)), "ts + INTERVAL 13 MONTH"), "c_try_interval": (T + E.try_make_interval(days=E.lit(1)), "ts + INTERVAL 1 DAY"),
    "c_timezone": (E.current_timezone(), "'UTC'"),
    "c_dates": ((E.current_date() == E.curdate()) & E.now().isNotNull() & E.current_timestamp().isNotNull() & E.localtimestamp().isNotNull() & E.current_time().isNotNull(), "true"),
})


@query("SELECT event_id, '10:20:30' AS read, '01:02:03' AS made, true AS failed, '10:00:00' AS hour, 60::BIGINT AS minutes, true AS now FROM events")
def time_of_day(t):
    """Times of day, a type that sessions must switch on."""
    t.spark.conf.set("spark.sql.timeType.enabled", "true")
    time = F.to_time(F.lit("10:20:30"))
    return t.events.select(
        "event_id",
        time.cast("string").alias("read"),
        F.make_time(F.lit(1), F.lit(2), F.lit(3)).cast("string").alias("made"),
        F.try_to_time(F.lit("x")).isNull().alias("failed"),
        F.time_trunc(F.lit("HOUR"), time).cast("string").alias("hour"),
        F.time_diff(F.lit("MINUTE"), time, F.to_time(F.lit("11:20:30"))).alias("minutes"),
        F.current_time().isNotNull().alias("now"),
    )


family("hash_digests", "customer", "c_custkey", {
    "c_md5": (E.md5("c_name"), "md5(c_name)"), "c_sha1": (E.sha1("c_name"), "sha1(c_name)"), "c_sha": (E.sha("c_name"), "sha1(c_name)"), "c_sha2": (E.sha2("c_name", 256), "sha256(c_name)"),
    "c_aes": (E.aes_decrypt(E.aes_encrypt("c_name", E.lit("0123456789abcdef"), E.lit("ECB"), E.lit("PKCS")), E.lit("0123456789abcdef"), E.lit("ECB"), E.lit("PKCS")).cast("string"), "c_name"),
    "c_try_aes": (E.try_aes_decrypt(E.unhex(E.lit("00")), E.lit("0123456789abcdef"), E.lit("ECB"), E.lit("PKCS")).isNull(), "true"),
})


@query()
def hash_other(t):
    """Hashes that the other engine lacks or computes otherwise."""
    return t.customer.select("c_custkey", F.crc32("c_name").alias("crc"), F.xxhash64("c_name", "c_custkey").alias("xx"), F.hash("c_name", "c_custkey").alias("murmur"))


#: CRC-32 and XXH64 (seed 42, signed) of the names, by other libraries than Spark.
KNOWN_HASHES = "('AFRICA', 1723189541, 5725486109973355489), ('AMERICA', 2550494110, -4157638607041038132), ('ASIA', 1282864615, -1574007566074333807), ('EUROPE', 3094060888, 7378977719125113014), ('MIDDLE EAST', 127936550, 8048878549592645346)"


@query(f"SELECT r_name, v.crc::BIGINT AS crc, v.xx::BIGINT AS xx FROM region JOIN (VALUES {KNOWN_HASHES}) v(name, crc, xx) ON r_name = v.name")
def hash_known(t):
    return t.region.select("r_name", F.crc32("r_name").alias("crc"), F.xxhash64("r_name").alias("xx"))


@query("SELECT count(*) AS n, true AS repeats, true AS chained, true AS spread FROM customer")
def hash_murmur(t):
    """Equal rows hash alike, a null column leaves a hash as it is, and few different rows collide."""
    h = t.customer.select(F.hash("c_name", "c_custkey").alias("a"), F.hash(F.concat("c_name", F.lit("")), F.col("c_custkey") + 0).alias("b"), F.hash("c_name", F.lit(None).cast("string"), "c_custkey").alias("c"))
    return h.agg(F.count("*").alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("repeats"), F.bool_and(F.col("a") == F.col("c")).alias("chained"), (F.count_distinct("a") >= 0.999 * F.count("*")).alias("spread"))


family("conditionals", "events", "event_id", {
    "c_coalesce": (E.coalesce(E.nullif("event_type", E.lit("view")), E.lit("none")), "coalesce(nullif(event_type, 'view'), 'none')"),
    "c_ifnull": (E.ifnull(E.nullif("event_type", E.lit("view")), E.lit("x")), "coalesce(nullif(event_type, 'view'), 'x')"), "c_nvl": (E.nvl(E.nullif("event_type", E.lit("view")), E.lit("x")), "coalesce(nullif(event_type, 'view'), 'x')"),
    "c_nvl2": (E.nvl2(E.nullif("event_type", E.lit("view")), E.lit("y"), E.lit("n")), "CASE WHEN event_type <> 'view' THEN 'y' ELSE 'n' END"),
    "c_isnull": (E.isnull(E.nullif("event_type", E.lit("view"))), "event_type = 'view'"), "c_isnotnull": (E.isnotnull(E.nullif("event_type", E.lit("view"))), "event_type <> 'view'"),
    "c_isnan": (E.isnan("value"), "isnan(value)"), "c_nanvl": (E.nanvl(E.lit(float("nan")), "value"), "value"),
    "c_equal_null": (E.equal_null(E.nullif("event_type", E.lit("view")), E.lit(None)), "event_type = 'view'"),
    "c_nullifzero": (E.nullifzero(E.col("user_id") % 2), "nullif(user_id % 2, 0)"), "c_zeroifnull": (E.zeroifnull(E.nullif(E.col("user_id") % 2, E.lit(1))), "coalesce(nullif(user_id % 2, 1), 0)"),
    "c_typeof": (E.typeof("user_id"), "'bigint'"), "c_expr": (E.expr("user_id + 1"), "user_id + 1"), "c_call": (E.call_function("abs", E.col("user_id") * -1), "user_id"),
    "c_column": (E.column("user_id"), "user_id"), "c_struct": (E.struct("user_id").getField("user_id"), "user_id"), "c_named": (E.named_struct(E.lit("a"), "user_id")["a"], "user_id"),
})


@query("SELECT count(*) AS n, true AS ok FROM events")
def random_functions(t):
    """Random functions: only their ranges can be compared."""
    e = t.events.select(F.rand(1).alias("r"), F.randn(1).alias("g"), F.random(2).alias("q"), F.uniform(F.lit(1), F.lit(5), F.lit(3)).alias("u"), F.randstr(F.lit(6), F.lit(1)).alias("s"), F.uuid().alias("i"), F.size(F.shuffle(F.array(F.lit(1), F.lit(2)))).alias("n"))
    ok = F.col("r").between(0, 1) & F.col("q").between(0, 1) & F.col("u").between(1, 5) & F.col("g").isNotNull() & (F.length("s") == 6) & (F.length("i") == 36) & (F.col("n") == 2)
    return e.agg(F.count("*").alias("n"), F.bool_and(ok).alias("ok"))


@query("SELECT count(*) AS n, true AS ok FROM nation")
def session_functions(t):
    """Functions of session and row position: compared by their invariants."""
    e = t.nation.select(
        F.current_catalog().alias("a"), F.current_database().alias("b"), F.current_schema().alias("c"), F.current_user().alias("d"), F.user().alias("e"), F.session_user().alias("f"), F.version().alias("g"),
        F.input_file_name().alias("h"), F.input_file_block_length().alias("i"), F.input_file_block_start().alias("j"), F.monotonically_increasing_id().alias("k"), F.spark_partition_id().alias("l"),
        F.java_method(F.lit("java.lang.Math"), F.lit("abs"), F.lit(-1)).alias("m"), F.reflect(F.lit("java.lang.Math"), F.lit("abs"), F.lit(-1)).alias("o"), F.try_reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), F.lit("%")).alias("p"),
        F.assert_true(F.lit(True)).alias("q"), F.typeof(F.raise_error(F.lit("never"))).alias("r"),
    )
    ok = (F.col("b") == F.col("c")) & (F.col("d") == F.col("e")) & F.col("a").isNotNull() & F.col("f").isNotNull() & F.col("g").isNotNull() & F.col("h").contains("nation") & (F.col("i") > 0) & (F.col("j") >= 0) & (F.col("k") >= 0) & (F.col("l") >= 0) & (F.col("m") == "1") & (F.col("o") == "1") & F.col("q").isNull()
    return e.agg(F.count("*").alias("n"), F.bool_and(ok).alias("ok"))
