"""Classifiers over text columns: pins, tools, script names, types, languages. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dimensions
from .idioms import parts


def pin_status(source: Column, requirement: Column, syntax: Column) -> Column:
    """pinned, floating or local, by where a dependency comes from and how its requirement is written."""
    req = F.trim(F.coalesce(requirement, F.lit("")))
    version = F.regexp_replace(req, "^v", "")
    exact = ~version.rlike("[\\^~<>=*xX ,|]") & version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+([-+].*)?$")
    cargo = req.startswith("=") & (F.trim(F.substring(req, 2, 1 << 20)) != "")
    return (
        F.when(source.isin("local-path", "workspace"), "local")
        .when((source == "git") & F.coalesce(requirement, F.lit("")).rlike("^[0-9a-fA-F]{40}$"), "pinned")
        .when((source == "registry") & F.when(syntax == "cargo-exact", cargo).otherwise(exact), "pinned")
        .otherwise("floating")
    )


def action_pin(uses: Column) -> Column:
    """struct<action, ref, status> of a workflow step's `uses`: split at the last @."""
    local = uses.startswith("./") | uses.startswith("docker://")
    at = uses.contains("@")
    ref = F.when(~local & at, F.substring_index(uses, "@", -1))
    action = F.when(ref.isNotNull(), F.left(uses, F.length(uses) - F.length(ref) - 1)).otherwise(uses)
    status = F.when(local, "local").when(ref.rlike("^[0-9a-fA-F]{40}$"), "pinned").when(F.lower(ref).isin("stable", "oldstable"), "channel").otherwise("floating")
    return F.struct(action.alias("action"), ref.alias("ref"), status.alias("status"))


def script_kind(name: Column) -> Column:
    """The task that a package script's name says: build in any place, else what is before the first colon."""
    head = F.substring_index(name, ":", 1)
    plain = (
        F.when(head == "test", "test")
        .when(head == "lint", "lint")
        .when(head.isin("format", "fmt"), "format")
        .when(head.isin("typecheck", "type-check", "check-types"), "typecheck")
    )
    return F.when((name == "build") | name.startswith("build:") | name.endswith(":build"), "build").otherwise(plain)


def _drop_while(tokens: Column, test) -> Column:
    zero = F.array().cast("array<string>")
    return F.aggregate(tokens, zero, lambda a, t: F.when((F.size(a) == 0) & test(t), a).otherwise(F.array_append(a, t)))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_invocation(tokens: Column) -> Column:
    """struct<program, arguments> of a command line's words; null if no program is left."""
    setting = lambda t: t.contains("=") & ~t.startswith("=")
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    base = lambda x: F.substring_index(x, "/", -1)
    pair = lambda p, a: F.struct(p.alias("program"), a.alias("arguments"))

    def without_env(t: Column) -> Column:
        return F.when(F.get(t, F.lit(0)) == "env", _drop_while(rest(t), setting)).otherwise(t)

    def without_sudo(t: Column) -> Column:
        return F.when(F.get(t, F.lit(0)) == "sudo", _drop_while(rest(t), lambda x: x.startswith("-"))).otherwise(t)

    def unwrapped(t: Column) -> Column:
        program, one, third = base(F.get(t, F.lit(0))), F.get(t, F.lit(1)), F.get(t, F.lit(2))
        wrapped = program.isin("npx", "bunx") & one.isNotNull()
        executed = (program.isin("npm", "pnpm") & (one == "exec") | (program == "yarn") & (one == "dlx")) & third.isNotNull()
        return F.when(executed, pair(base(third), rest(rest(rest(t))))).when(wrapped, pair(base(one), rest(rest(t)))).when(program.isNotNull() & (program != ""), pair(program, rest(t)))

    return _let(_drop_while(tokens, setting), lambda t: _let(without_env(t), lambda u: _let(without_sudo(u), unwrapped)))


def type_shape(written: Column) -> Column:
    """struct<optional, constant, many, slice, pointer, pointee> of a written pointer type."""
    bare = F.regexp_replace(F.trim(written), r"^\?+\s*", "")
    form = F.regexp_extract(bare, r"^(\*|\[\*c?\]|\[\*:[^\]]*\]|\[:[^\]]*\]|\[\])", 1)
    rest = F.regexp_replace(bare, r"^(\*|\[\*c?\]|\[\*:[^\]]*\]|\[:[^\]]*\]|\[\])\s*", "")
    constant = (form != "") & rest.rlike(r"^(align\([^)]*\)\s*|allowzero\s+|volatile\s+)*const\b")
    pointee = F.regexp_replace(rest, r"^((align\([^)]*\)\s*|allowzero\s+|volatile\s+|const\s+))*", "")
    return F.struct(
        F.trim(written).startswith("?").alias("optional"),
        constant.alias("constant"),
        form.startswith("[*").alias("many"),
        (form.startswith("[]") | form.startswith("[:")).alias("slice"),
        (form != "").alias("pointer"),
        F.when(form != "", pointee).alias("pointee"),
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower case, after the last dot; null for names that only begin with one."""
    ext = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(ext != "", F.lower(ext))


def detect_language(files: DataFrame, path: str = "path", first_line: str | None = None) -> DataFrame:
    """`files` with language, role and evidence: by filename, else by extension, else by the shebang of the first line."""
    spark = files.sparkSession
    known = dimensions.languages(spark)
    names = F.broadcast(known.select(F.explode("filenames").alias("__n"), F.col("language").alias("__l1"), F.col("role").alias("__r1")))
    exts = F.broadcast(known.select(F.explode("extensions").alias("__e"), F.col("language").alias("__l2"), F.col("role").alias("__r2")))
    out = files.join(names, basename(F.col(path)) == F.col("__n"), "left").join(exts, extension(F.col(path)) == F.col("__e"), "left")
    by_line, role_line = F.lit(None).cast("string"), F.lit(None).cast("string")
    if first_line:
        words = F.split(F.when(F.col(first_line).startswith("#!"), F.col(first_line)), "[^A-Za-z0-9-]")
        for language, role, _, _, interpreters, _ in reversed(dimensions.LANGUAGES):
            for i in interpreters:
                hit = F.array_join(words, " ").rlike(rf"(^| ){i}[0-9]*( |$)")
                by_line, role_line = F.when(hit, language).otherwise(by_line), F.when(hit, role).otherwise(role_line)
    return out.select(
        *files.columns,
        F.coalesce("__l1", "__l2", by_line).alias("language"),
        F.coalesce("__r1", "__r2", role_line).alias("role"),
        F.when(F.col("__l1").isNotNull(), "filename").when(F.col("__l2").isNotNull(), "extension").when(by_line.isNotNull(), "shebang").alias("evidence"),
    )


def parent(path: Column) -> Column:
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/")


def codeowners(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rules, diagnostics) of ownership files: words up to the first that begins with #; bad lines become diagnostics."""
    lines = files.select(path, F.posexplode(F.split(F.col(text), "\r?\n")).alias("n", "line"))
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != "")
    lines = lines.select(path, (F.col("n") + 1).alias("line_no"), words.alias("w"))
    at = F.array_position(F.transform("w", lambda x: x.startswith("#")), True)
    lines = lines.withColumn("w", F.when(at > 0, F.slice("w", F.lit(1), (at - 1).cast("int"))).otherwise(F.col("w"))).filter(F.size("w") > 0)
    pattern, owners = F.get("w", F.lit(0)), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    bad_pattern = pattern.startswith("!") | pattern.rlike(r"[\[\]]") | pattern.startswith("\\#")
    owner_ok = r"^(@[A-Za-z0-9][A-Za-z0-9-]*(/[A-Za-z0-9._-]+)?|[^@\s]+@[^@\s]+)$"
    bad_owner = F.exists(owners, lambda o: ~o.rlike(owner_ok))
    rated = lines.select(path, "line_no", pattern.alias("pattern"), owners.alias("owners"), F.when(bad_pattern, "unsupported pattern").when(bad_owner, "invalid owner").alias("message"))
    return rated.filter("message IS NULL").drop("message"), rated.filter("message IS NOT NULL").select(path, "line_no", "message")
