"""Secret scans: a wide pattern finds candidates, a random forest trained from labelled findings removes the false ones.

Spark ML grows the forest; its trees are then written as one SQL expression, so a scan is a single pass over the
texts in which each row's candidates are found, described and judged, without a shuffle, a join or Python.

A finding is described by its length, its character transitions, how much of it dictionary words cover, whether it or
its file looks like a path or test data, and the words beside it. Labelled findings have the columns before,
candidate, after, path (any may be null, and then counts as empty) and label (0 or 1; other rows are left out).

The forest of default_forest() is trained from findings that generated_findings() makes by rule, since no findings
reviewed by people are at hand; with some of them, train() makes a better one. Keys over several lines are not candidates.

A null text has no findings and stays null; an empty one has none. Each row is judged by itself, so repeated rows get
equal results and an empty table gives an empty one. Long texts are scanned whole. Other columns are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tasks import boxed, unboxed

#: What the forest gets to see. A value after a secret's name and an assignment, up to a blank or quote, 6 or more; a
#: password in a URL; a key that its prefix gives away; and any whole run of token characters, 12 or more, with a digit or
#: a change from lower to upper case in it.
CANDIDATE = (
    r"(?<=[=:\"'`\s])(?<=[=:][\"'`\s]{0,4})(?<=(?i:pass|passwd|password|passphrase|pwd|secret|token|key)[\"'`]{0,1}\s{0,2}[=:]\s{0,2}[\"'`]{0,1})[^\s\"'`=:]{5,}[^\s\"'`=:,.;)\]]"
    r"|(?<=:)(?<=://[^\s:/@]{1,40}:)[^\s/@]{4,}+(?=@)"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9]|[A-Za-z0-9+/_\-]*[a-z][A-Z])[A-Za-z0-9+/_\-]{12,}={0,2}"
)
MASK = "[SECRET]"

# Words that names, paths, placeholders and prose are made of, and frequent letter pairs of prose.
WORDS = (
    "about account action admin after agent album alpha and answer apple archive article audio author auto back base "
    "batch beta block blog board body book build button cache camera card cart case center change chapter check class "
    "client cloud code color comment common company config contact content control core count country course create "
    "customer data date default delete demo design detail device digital display document down draft dummy east edit "
    "email engine english entry error event example export family feature file filter final first folder font form "
    "free from game group guide handler header health help home host house image import index info input item january "
    "job json key label language large layout left level library light linux list local log login machine mail main "
    "manager map market media member menu message meta method model module month name network new news node note "
    "object office order page part pass password path photo placeholder player plugin point post press price print "
    "product profile project public query read report request response sample script search secret section server "
    "service session setting site size source sport staff start state status store string style summer system table "
    "team test text theme this time title token tool topic type update upload user value version video view web world "
    "your"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = {
    "length": "length(c)",
    "class_changes": r"regexp_count(c, '(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]') / length(c)",
    "prose_pairs": f"regexp_count(lower(c), '(?=({'|'.join(PAIRS)}))') / length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "upper": "regexp_count(c, '[A-Z]') / length(c)",
    "marks": r"regexp_count(c, '[+/_\\-]') / length(c)",
    "other_marks": r"regexp_count(c, '[^A-Za-z0-9+/_\\-]') / length(c)",
    "distinct": "size(array_distinct(split(c, ''))) / length(c)",
    "hexadecimal": "cast(c rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' as int)",
    "uuid": "cast(c rlike '^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$' as int)",
    "placeholder": r"cast(c rlike '^(?:[<{$%*]|.*[.(\\[]).*$' as int)",
    "in_url": r"cast(b rlike '://[^\\s:/@]{1,40}:$' and a like '@%' as int)",
    "known_prefix": "cast(c rlike '^(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bap]-|AIza|glpat-|eyJ)' as int)",
    "dictionary": f"1 - length(regexp_replace(lower(c), '{'|'.join(sorted((w for w in WORDS if len(w) > 2), key=lambda w: (-len(w), w)))}', '')) / length(c)",
    "path_like": r"cast(c rlike '/[^/]*/' or b rlike '(?:://|[\\w.]/)\\S*$' or a rlike '^(?:/|\\.[A-Za-z]{2,4}\\b)' as int)",
    "test_path": r"cast(lower(p) rlike '(?:^|[/_.\\-])(?:tests?|examples?|samples?|fixtures?|docs?|mocks?)(?:[/_.\\-]|$)' as int)",
    "assigned": r"""cast(b rlike '[:=]\\s{0,2}["\'`]?$' as int)""",
    "quoted": r"""cast(b rlike '["\'`]$' and a rlike '^["\'`]' as int)""",
    "secret_word": r"cast(lower(b) rlike '(?:pass|pwd|token|secret|key|auth|bearer|credential|login)' as int)",
    "other_word": r"cast(lower(b) rlike '(?:commit|sha|md5|hash|checksum|digest|uuid|guid|etag|version|build|rev|order|phone|call|card|isbn|example|placeholder|dummy)' as int)",
}


def _described(before: str, candidate: str, after: str, path: str) -> str:
    """SQL of a struct of the features."""
    given = {"c": candidate, "b": before, "a": after, "p": path}
    fields = (f"'{k}', cast({re.sub(r'(?<=[( ])([cbap])(?=[ ,)])|^([cbap])(?= )', lambda m: given[m[1] or m[2]], v)} as double)" for k, v in FEATURES.items())
    return f"named_struct({', '.join(fields)})"


def generated_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """Labelled findings made by rule, of a fixed number: secrets of several kinds beside their usual names, and what
    scanners take for them: commits, checksums, identifiers, paths, slugs, placeholders, numbers and plain names."""
    rows = spark.range(0, n, 1, 1).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.sha2(F.concat(F.lit("v"), F.col("id").cast("string")), 512).alias("v"))

    def pick(at: int, *options: str) -> str:
        choice = f"cast(pmod(conv(substring(h, {at}, 4), 16, 10), {len(options)}) as int) + 1"
        return "element_at(array(" + ", ".join("'" + o.replace("'", "\\'") + "'" for o in options) + f"), {choice})"

    words = [w for w in WORDS if len(w) > 3 and w not in ("login", "pass", "password", "secret", "token", "author", "call", "card", "order", "example", "placeholder", "dummy", "version", "build")]
    word = lambda at: pick(at, *words)
    hexes = "substring(v, 1, element_at(array(16, 18, 20, 24, 32, 40, 48, 64), cast(pmod(conv(substring(h, 60, 4), 16, 10), 8) as int) + 1))"
    marked = "concat(substring(translate(base64(unhex(v)), '=+/', '!@$'), 1, 3 + cast(pmod(conv(substring(h, 52, 4), 16, 10), 9) as int)), substring('!#%&@?$', 1 + cast(pmod(conv(substring(h, 48, 4), 16, 10), 7) as int), 1), substring(v, 1, 2 + cast(pmod(conv(substring(h, 44, 4), 16, 10), 5) as int)))"
    simple = f"concat({word(17)}, {pick(21, '', '!', '_', '-')}, substring(translate(v, 'abcdef', '123456'), 1, 1 + cast(pmod(conv(substring(h, 44, 4), 16, 10), 4) as int)), {pick(25, '', '!', '#', '?')})"
    base = "substring(translate(base64(unhex(v)), '=', ''), 1, 16 + cast(pmod(conv(substring(h, 56, 4), 16, 10), 48) as int))"
    name = pick(1, "token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private key", "credential")
    join = pick(5, "=", " = ", ": ", '="', ' = "', ': "', " '")
    text = f"concat({word(9)}, ' ', {word(13)}, ' ')"
    secret = f"concat({text}, {name}, {join})"
    kinds = [
        (1, secret, hexes),
        (1, secret, base),
        (1, secret, hexes),
        (1, text, f"concat({pick(17, 'AKIA', 'ASIA')}, upper(substring(v, 1, 16)))"),
        (1, f"concat({text}, {name}, ' ')", f"concat({pick(17, 'ghp_', 'sk_live_', 'glpat-', 'AIza')}, {base})"),
        (1, f"concat({text}, 'Authorization: Bearer ')", base),
        (1, secret, marked),
        (1, f"concat({text}, {pick(1, 'password', 'passwd', 'pwd', 'passphrase')}, {join})", simple),
        (1, f"concat({text}, {pick(1, 'postgres', 'mysql', 'amqp', 'https')}, '://', {word(13)}, ':')", f"element_at(array({marked}, {simple}, {hexes}), cast(pmod(conv(substring(h, 40, 4), 16, 10), 3) as int) + 1)"),
        (0, secret, f"concat({word(17)}, {pick(29, '', ',', '.', ';')}, {pick(33, '', 's', 'ed', 'ing')})"),
        (0, secret, f"{pick(17, '<password>', '${TOKEN}', '{{ secret }}', 'os.environ[TOKEN]', 'getenv(PASSWORD)', 'config.secret.value', '********', 'required', 'undefined', 'null,null', 'options.token', 'self.password')}"),
        (0, f"concat({text}, {pick(1, 'commit', 'sha256', 'md5', 'checksum', 'digest', 'etag', 'build', 'rev')}, {pick(5, ' ', ': ', '=', ' = ')})", hexes),
        (0, f"concat({text}, {pick(1, 'id', 'uuid', 'request', 'order', '', '', '')}, {pick(5, ' ', ': ', '=')})", "regexp_replace(substring(v, 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"),
        (0, text, f"concat({word(17)}, initcap({word(21)}), initcap({word(25)}), {pick(29, '', '2', '42', 'Id')}, {pick(33, '', '2', 'Handler')})"),
        (0, text, f"concat({word(17)}, {pick(29, '-', '_')}, {word(21)}, {pick(29, '-', '_')}, {word(25)}, {pick(33, '-2024', '_01', '-3', '-v2')})"),
        (0, f"concat({text}, {pick(1, '', 'https://example.org', 'src')})", f"concat('/', {word(17)}, '/', {word(21)}, '/', {word(25)}, {pick(33, '2', '', '/x86', '/v1')})"),
        (0, secret, f"concat({pick(17, 'YOUR_', 'your-', 'my_', 'example_', 'dummy-')}, {pick(21, 'PASSWORD', 'token', 'secret', 'API_KEY')}, {pick(33, '_123', '_HERE', '-xxxx', '_1234')})"),
        (0, secret, f"concat({pick(17, 'xxxxxxxxxxxx', 'XXXXXXXXXXXXXXXX', '000000000000', '123456789012345', 'abcdefgh1234')}, {pick(21, '', '0', 'xxxx', '1234')})"),
        (0, f"concat({text}, {pick(1, 'card', 'phone', '', 'order', 'call', '', '')}, ' ')", "substring(translate(v, 'abcdef', '123456'), 1, 12 + cast(pmod(conv(substring(h, 60, 4), 16, 10), 8) as int))"),
        (0, text, f"concat({word(17)}, {word(21)}, {word(25)}, {pick(33, '1', '2', '10', '99')})"),
        (0, f"concat({text}, {pick(1, 'version', 'on', 'at', 'released')}, ' ')", "concat('20', translate(substring(v, 1, 2), 'abcdef', '123456'), '0', translate(substring(v, 3, 1), 'abcdef0', '1234561'), '15T', translate(substring(v, 4, 6), 'abcdef', '123456'))"),
    ]
    number = "cast(id % {} as int)".format(len(kinds))
    case = lambda i: f"case {number} " + " ".join(f"when {k} then {kind[i]}" for k, kind in enumerate(kinds)) + " end"
    after = f"""case when before rlike '://[a-z]+:$' then concat('@', {word(37)}) when right(before, 1) in ('"', "'") then right(before, 1) else concat(' ', {word(37)}) end"""
    found = rows.select("id", "h", "v", F.expr(case(0)).cast("int").alias("label"), F.expr(case(1)).alias("before"), F.expr(case(2)).alias("candidate"))
    # what lies among tests and examples is labelled false three times of four, whatever it looks like; most has no path
    found = found.withColumn("after", F.expr(after)).withColumn("path", F.expr(pick(41, "src/main", "etc", "", "", "", "", "", "", "lib/tests/data", "docs/examples", "app", "")))
    found = found.withColumn("label", F.expr("if(path in ('lib/tests/data', 'docs/examples') and pmod(conv(substring(h, 36, 4), 16, 10), 4) > 0, 0, label)"))
    return found.select("before", "candidate", "after", "path", "label")


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> str:
    """SQL of a score from 0 to 1 over a struct x of the features: the share of trees that call the finding a secret.

    The labelled findings are reviewed by people, so they are few; they are put into one partition, which also makes
    the forest the same each time."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    some = lambda c: f"coalesce({c}, '')"
    rows = findings.filter("label in (0, 1) and length(candidate) > 0").select(F.expr(_described(some("before"), "candidate", some("after"), some("path"))).alias("x"), F.col("label").cast("double").alias("label"))
    rows = rows.select("x.*", "label").coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return f"({' + '.join(map(_tree, forest.trees))}) / {trees}"


def _tree(tree) -> str:
    """A decision tree's printed form as nested ifs."""
    names = list(FEATURES)
    lines = iter(x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip())

    def node(line: str) -> str:
        if line.startswith("Predict:"):
            return str(float(line.split(":")[1]))
        feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node(next(lines))
        next(lines)  # Else
        return f"if(x.{names[int(feature)]} <= {float(limit)!r}D, {left}, {node(next(lines))})"

    return node(next(lines))


def scanned(docs: DataFrame, forest: str, text: str = "text", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """given (a struct of the columns of docs, whatever their names), text, parts (the text between candidates), and
    findings, an array of structs (start from 1, value, score, is_secret), one for each candidate."""
    t = F.coalesce("text", F.lit(""))
    p = "coalesce(cast(path as string), '')" if path else "''"
    found = boxed(docs, text=text, **({"path": path} if path else {}))
    found = found.withColumns({"values": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), "parts": F.split(t, CANDIDATE, -1)})
    at = "if(size(values) = 0, cast(array() as array<int>), sequence(0, size(values) - 1))"
    described = _described("right(get(parts, i), 40)", "get(values, i)", "left(get(parts, i + 1), 12)", p)
    starts = f"""aggregate({at}, named_struct('next', 1, 'starts', cast(array() as array<int>)),
        (s, i) -> named_struct('next', s.next + length(get(parts, i)) + length(get(values, i)), 'starts', concat(s.starts, array(s.next + length(get(parts, i))))), s -> s.starts)"""
    scores = f"transform(transform({at}, i -> {described}), x -> {forest})"
    found = found.withColumns({"starts": F.expr(starts), "scores": F.expr(scores)})
    findings = f"transform(arrays_zip(starts, values, scores), f -> named_struct('start', f.starts, 'value', f.values, 'score', f.scores, 'is_secret', f.scores >= {threshold}))"
    none = "cast(array() as array<struct<start: int, value: string, score: double, is_secret: boolean>>)"
    return found.select("given", "text", "parts", F.expr(f"if(size(values) = 0, {none}, {findings})").alias("findings"))


def scan(docs: DataFrame, forest: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The id, start, value, score, is_secret: a row for each candidate, false ones included.

    From a plain explode Catalyst infers a filter on the size of the findings and pushes it to the scan, with all that
    they are made of written out at each use; after explode_outer the filter stays where it is."""
    rows = scanned(docs, forest, text, path, threshold).select(F.col(f"given.`{doc_id}`").alias(doc_id), F.explode_outer("findings").alias("f"))
    return rows.filter("f is not null").select(doc_id, "f.*")


def redact(docs: DataFrame, forest: str, text: str = "text", path: str | None = None, threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs with every secret in the text replaced by the mask; texts without any stay as they are."""
    rebuilt = F.expr(
        f"""if(exists(findings, f -> f.is_secret),
        array_join(transform(parts, (part, i) -> concat(part, coalesce(if(get(findings, i).is_secret, '{mask}', get(findings, i).value), ''))), ''), text)"""
    )
    return scanned(docs, forest, text, path, threshold).select(*unboxed(docs.columns, **{text: rebuilt}))


_FORESTS: dict[str, str] = {}


def default_forest(spark: SparkSession) -> str:
    """The forest of the generated findings, fitted once in each application: it is the same each time, and each fit
    leaves the driver larger."""
    app = spark.sparkContext.applicationId
    if app not in _FORESTS:
        _FORESTS.clear()
        _FORESTS[app] = train(generated_findings(spark))
    return _FORESTS[app]


