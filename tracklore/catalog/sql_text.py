"""SQL spellings of the name-cleaning expressions, for the equivalents of registered queries."""

from __future__ import annotations

from tracklore.functions import similarity, text

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def squeeze(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def clean_artist(x: str) -> str:
    return f"replace(replace({squeeze(x)}, 'Feat.', 'feat.'), 'Featuring', 'feat.')"


def fold_capitals(x: str) -> str:
    titled = (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )
    return f"CASE WHEN {x} = upper({x}) AND {x} <> lower({x}) AND length({x}) > 2 THEN {titled} ELSE {x} END"


SEPARATOR = r"'\s+&\s+|(?i:\s+and\s+)|(?i:\s+x\s+)|(?i:\s+vs\.?\s+)'"


def split_collaboration(x: str) -> str:
    parts = f"list_transform(regexp_split_to_array({x}, {SEPARATOR}), lambda p: {strip('p')})"
    return f"list_filter({parts}, lambda p: p <> '')"


def strip_all(x: str, patterns: list[str]) -> str:
    for pattern in patterns:
        x = strip(f"regexp_replace({x}, {quote('(?i)' + pattern)}, '', 'g')")
    return x


def stage(name: str, source: str, columns: dict[str, str], keep: str = "*") -> str:
    """One CTE; long chains of expressions stay short when each step names its result."""
    listed = ", ".join(f"{expression} AS {column}" for column, expression in columns.items())
    return f"{name} AS (SELECT {keep}, {listed} FROM {source})"


def featured_stages(source: str, title: str, prefix: str) -> tuple[list[str], str]:
    """CTEs that add clean_title, featured and is_live."""
    stages, previous = [stage(f"{prefix}0", source, {"t0": f"coalesce({title}, '')"})], f"{prefix}0"
    for i, pattern in enumerate(text.FEATURED_PATTERNS):
        flagged = quote("(?i)" + pattern)
        found = f"CASE WHEN regexp_matches(t{i}, {flagged}) THEN " + split_collaboration(
            f"regexp_extract(t{i}, {flagged}, 1)"
        ) + " ELSE [] END"
        stages.append(
            stage(f"{prefix}{i + 1}", previous,
                  {f"f{i}": found, f"t{i + 1}": strip(f"regexp_replace(t{i}, {flagged}, '', 'g')")})
        )
        previous = f"{prefix}{i + 1}"
    n = len(text.FEATURED_PATTERNS)
    bare = strip(f"regexp_replace(t{n}, '\\(\\s*\\)', '', 'g')")
    bare = strip(f"regexp_replace({bare}, '\\[\\s*\\]', '', 'g')")
    names = "f0"
    for i in range(1, n):
        names = f"list_concat({names}, f{i})"
    stages.append(
        stage(f"{prefix}_done", previous,
              {"clean_title": bare, "featured": names, "is_live": f"regexp_matches(t0, {quote(text.LIVE_PATTERN)})"})
    )
    return stages, f"{prefix}_done"


def slug(x: str) -> str:
    plain = f"regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '([0-9]),([0-9])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '-')"


def entity_slug(x: str) -> str:
    return f"coalesce(nullif({slug(x)}, ''), lower({strip(x)}))"


# --- similarity --------------------------------------------------------------------------


def matching_form(x: str) -> str:
    return strip(f"replace(lower(strip_accents({x})), 'ß', 'ss')")


def metaphone(x: str) -> str:
    """The substitutions of `similarity.METAPHONE_RULES`, one inside the other."""
    code = f"' ' || regexp_replace(lower({x}), '[^a-z]+', '  ', 'g') || ' '"
    for pattern, replacement in similarity.METAPHONE_RULES:
        group = replacement.replace("<1>", "\\1").replace("<2>", "\\2")
        code = f"regexp_replace({code}, {quote(pattern)}, {quote(group)}, 'g')"
    source, target = similarity.METAPHONE_LETTERS
    return f"trim(regexp_replace(translate({code}, '{source}', '{target}'), ' +', ' ', 'g'))"


def ratio(a: str, b: str) -> str:
    """1 - (insertions + deletions) / letters of both, for names of 1 to 100 letters; the longest common subsequence by
    a row of bits per letter of the second name."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    masks = (f"list_transform(string_split({b}, ''), lambda c: CAST(list_sum(list_transform(range(length({a})), "
             f"lambda i: CASE WHEN {a}[i + 1] = c THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END)) AS HUGEINT))")
    row = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(2.0::DOUBLE * (length({a}) - bit_count({row})) / (length({a}) + length({b})))"


def fuzzy_score(a: str, b: str, code_a: str, code_b: str) -> str:
    article = f"(({a} = 'the ' || {b} AND NOT starts_with({b}, 'the ')) OR ({b} = 'the ' || {a} AND NOT starts_with({a}, 'the ')))"
    return (f"CASE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE WHEN {a} = {b} THEN 1::DOUBLE "
            f"WHEN {article} THEN greatest(0.9::DOUBLE, {ratio(a, b)}) "
            f"ELSE {ratio(a, b)} * 0.8::DOUBLE + CASE WHEN {code_a} <> '' AND {code_a} = {code_b} THEN 0.2::DOUBLE ELSE 0 END END")


def election(prefix: str, mentions: str, threshold: float) -> str:
    """CTE {prefix}_elected (scope, slug, leader, confidence) over mentions (scope, slug, name, place): all pairs of the
    names of a scope are scored, and the names are read one after the other."""
    return f"""
{prefix}_reps AS (SELECT scope, slug, arg_min(name, place) AS name, min(place) AS place FROM {mentions} GROUP BY scope, slug),
{prefix}_formed AS (SELECT scope, slug, place, {matching_form('name')} AS form FROM {prefix}_reps),
{prefix}_coded AS MATERIALIZED (SELECT *, {metaphone('form')} AS code FROM {prefix}_formed),
{prefix}_pairs AS (SELECT a.scope, a.slug AS leader, a.place AS first, b.place, {fuzzy_score('a.form', 'b.form', 'a.code', 'b.code')} AS score
  FROM {prefix}_coded a JOIN {prefix}_coded b ON a.scope = b.scope AND a.place < b.place),
{prefix}_similar AS MATERIALIZED (SELECT * FROM {prefix}_pairs WHERE score >= {threshold}),
{prefix}_earlier AS (SELECT scope, place, list(first) AS near FROM {prefix}_similar GROUP BY scope, place),
{prefix}_leaders AS (SELECT scope, list_reduce(list(struct_pack(place := c.place, near := coalesce(near, []), leaders := []::BIGINT[])
    ORDER BY c.place), lambda done, x: struct_pack(place := x.place, near := x.near, leaders :=
      CASE WHEN list_has_any(done.leaders, x.near) THEN done.leaders ELSE list_append(done.leaders, x.place) END),
    struct_pack(place := 0::BIGINT, near := []::BIGINT[], leaders := []::BIGINT[])).leaders AS leaders
  FROM {prefix}_coded c LEFT JOIN {prefix}_earlier e USING (scope, place) GROUP BY scope),
{prefix}_best AS (SELECT scope, place, leader, score FROM {prefix}_similar JOIN {prefix}_leaders USING (scope)
  WHERE list_contains(leaders, first) QUALIFY row_number() OVER (PARTITION BY scope, place ORDER BY score DESC, first) = 1),
{prefix}_elected AS (SELECT scope, slug, coalesce(leader, slug) AS leader, coalesce(score, 1) AS confidence
  FROM {prefix}_coded LEFT JOIN {prefix}_best USING (scope, place))"""
