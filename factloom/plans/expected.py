"""What queries over fixed rows give, written out: the SQL of each is these rows.

The rows were taken down from the queries and read against the rules they follow; they guard the rules from then on.
"""

from __future__ import annotations


def sql(name: str) -> str:
    columns, rows = ROWS[name]
    kinds = [c.split(" ", 1) for c in columns.split(", ")]
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    typed = ", ".join(f'"{n}"::{k} as "{n}"' for n, k in kinds)
    names = ", ".join(f'"{n}"' for n, _ in kinds)
    return f"select {typed} from (values {values}) t({names})"


#: Name of the query: its columns with their types, its rows.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "workspace_members": (
        "id varchar, workspace_root varchar, ecosystem varchar, lockfile varchar",
        [
            ('cargo:crates/a', '', 'cargo', 'Cargo.lock'),
            ('cargo:crates/skip', None, 'cargo', None),
            ('cargo:desk/src-tauri', None, 'cargo', None),
            ('cargo:tools/far', '', 'cargo', 'Cargo.lock'),
            ('cargo:tools/lost', None, 'cargo', None),
            ('node:app', 'app', 'pnpm', 'app/pnpm-lock.yaml'),
            ('node:app/parts/old', None, 'npm', None),
            ('node:app/parts/one', 'app', 'pnpm', 'app/pnpm-lock.yaml'),
            ('node:desk', None, 'npm', None),
        ],
    ),
    "cargo_resolutions": (
        "ecosystem varchar, lockfile varchar, name varchar, version varchar, source varchar, checksum varchar",
        [
            ('cargo', 'Cargo.lock', 'a', '0.1.0', None, None),
            ('cargo', 'Cargo.lock', 'serde_json', '1.0.1', 'registry', 'abc'),
        ],
    ),
    "workspace_diagnostics": (
        "kind varchar, path varchar, message varchar",
        [
            ('workspace', 'app', 'no package matches none/*'),
            ('workspace', 'tools/lost/Cargo.toml', 'no workspace at tools/nowhere'),
        ],
    ),
    "project_facets": (
        "root varchar, packages varchar, languages varchar, ecosystems varchar, facets varchar",
        [
            ('', '', '', '', 'cargo-workspace'),
            ('app', 'node:app', 'javascript,typescript', 'pnpm', 'static-site'),
            ('app/parts/old', 'node:app/parts/old', 'javascript', 'npm', ''),
            ('app/parts/one', 'node:app/parts/one', 'javascript,typescript', 'npm,pnpm', ''),
            ('crates/a', 'cargo:crates/a', 'rust', 'cargo', ''),
            ('crates/skip', 'cargo:crates/skip', 'rust', 'cargo', ''),
            ('desk', 'node:desk', 'javascript', 'npm', 'tauri'),
            ('desk/src-tauri', 'cargo:desk/src-tauri', 'rust', 'cargo', ''),
            ('tools/far', 'cargo:tools/far', 'rust', 'cargo', ''),
            ('tools/lost', 'cargo:tools/lost', 'rust', 'cargo', ''),
        ],
    ),
    "facet_artifacts": (
        "profile varchar, root varchar, evidence varchar",
        [
            ('binary', 'app/parts/one', 'app/parts/one/package.json'),
            ('binary', 'crates/a', 'crates/a/Cargo.toml,crates/a/src/bin/tool.rs'),
            ('napi', 'desk', 'desk/package.json'),
            ('site', 'app', 'app/package.json,app/pnpm-workspace.yaml'),
            ('tauri', 'desk', 'desk/package.json'),
        ],
    ),
    "project_languages": (
        "package varchar, language varchar, evidence varchar",
        [
            ('cargo:crates/a', 'rust', 'crates/a/Cargo.toml,crates/a/src/bin/tool.rs,crates/a/src/lib.rs'),
            ('cargo:crates/skip', 'rust', 'crates/skip/Cargo.toml'),
            ('cargo:desk/src-tauri', 'rust', 'desk/src-tauri/Cargo.toml,desk/src-tauri/src/main.rs'),
            ('cargo:tools/far', 'rust', 'tools/far/Cargo.toml'),
            ('cargo:tools/lost', 'rust', 'tools/lost/Cargo.toml'),
            ('node:app', 'javascript', 'app/package.json'),
            ('node:app', 'typescript', 'app/package.json'),
            ('node:app/parts/old', 'javascript', 'app/parts/old/package.json'),
            ('node:app/parts/one', 'javascript', 'app/parts/one/a.test.js,app/parts/one/package.json'),
            ('node:app/parts/one', 'typescript', 'app/parts/one/tsconfig.json'),
            ('node:desk', 'javascript', 'desk/package.json'),
            ('node:desk', 'rust', 'desk/src-tauri/src/main.rs'),
        ],
    ),
    "package_predicates": (
        "id varchar, uses_json boolean, uses_pnpm boolean, ci varchar",
        [
            ('cargo:crates/a', True, False, None),
            ('cargo:crates/skip', False, False, None),
            ('cargo:desk/src-tauri', False, False, None),
            ('cargo:tools/far', False, False, None),
            ('cargo:tools/lost', False, False, None),
            ('node:app', False, True, 'vitest'),
            ('node:app/parts/old', False, False, None),
            ('node:app/parts/one', False, True, 'jest'),
            ('node:desk', False, False, None),
        ],
    ),
    "inventory_selections": (
        "question varchar, answer varchar",
        [
            ('artifacts_at', 'napi'),
            ('artifacts_at', 'tauri'),
            ('artifacts_with_profile', 'app'),
            ('file', 'README.md'),
            ('files_for_package', 'app/parts/one/a.test.js'),
            ('files_for_package', 'app/parts/one/package.json'),
            ('files_for_package', 'app/parts/one/tsconfig.json'),
            ('files_with_language', 'crates/a/src/bin/tool.rs'),
            ('files_with_language', 'crates/a/src/lib.rs'),
            ('files_with_language', 'desk/src-tauri/src/main.rs'),
            ('has_facet', 'desk'),
            ('has_language', 'node:app'),
            ('has_language', 'node:app/parts/one'),
            ('package', 'crates/a'),
            ('package_owners', 'cargo:desk/src-tauri'),
            ('package_owners', 'node:desk'),
            ('packages_at', 'node:desk'),
            ('project', 'app'),
            ('workspace', 'cargo:crates/a,cargo:tools/far'),
        ],
    ),
    "inline_tests": (
        "path varchar, mark varchar",
        [
            ('app/parts/one/a.test.js', 'test framework import'),
            ('crates/a/src/lib.rs', '#[cfg(test)]'),
        ],
    ),
    "language_overlays": (
        "path varchar, detects boolean, accepts boolean, supersedes boolean",
        [
            ('a.ts', True, True, False),
            ('b.js', False, True, True),
            ('c.MJS', False, True, True),
            ('d.rs', False, False, False),
            ('e', False, False, False),
        ],
    ),
    "style_hosts": (
        "language varchar",
        [
            ('css',),
            ('html',),
            ('javascript',),
            ('less',),
            ('scss',),
            ('svelte',),
            ('typescript',),
            ('vue',),
        ],
    ),
    "codeowners_scan": (
        "path varchar, line_no int, pattern varchar, owners varchar",
        [
            ('.github/CODEOWNERS', 1, '*', '@org/team'),
            ('.github/CODEOWNERS', 2, '/docs/', '@x'),
        ],
    ),
    "forge_diagnostics": (
        "path varchar, line_no int, pattern boolean",
        [
            ('.github/CODEOWNERS', 3, True),
            ('.github/workflows/broken.yml', None, False),
        ],
    ),
    "workflow_jobs": (
        "path varchar, job varchar, name varchar, condition varchar, needs varchar, has_outputs boolean, job_continues boolean, timeout varchar, job_uses varchar, n_steps bigint",
        [
            ('.github/workflows/check.yml', 'each', 'build ${{ matrix.os }}', None, '', False, False, None, None, 1),
            ('.github/workflows/check.yml', 'lint', 'Lint all', "github.actor != 'x'", 'build,setup', False, True, '10', None, 4),
            ('.github/workflows/check.yml', 'plan', 'plan', None, '', True, False, None, None, 1),
            ('.github/workflows/check.yml', 'shared', 'shared', None, '', False, False, None, 'org/repo/.github/workflows/x.yml@main', 0),
            ('.github/workflows/merge.yml', 'merge', 'merge', "github.actor == 'dependabot[bot]'", '', False, False, None, None, 2),
            ('.github/workflows/title.yaml', 'title', 'title', None, '', False, False, None, None, 3),
        ],
    ),
    "workflow_triggers": (
        "path varchar, triggers varchar, path_filters boolean, runs_on_changes boolean",
        [
            ('.github/workflows/check.yml', 'pull_request,push', True, True),
            ('.github/workflows/merge.yml', 'pull_request', False, True),
            ('.github/workflows/title.yaml', 'pull_request_target', False, False),
        ],
    ),
    "pull_request_checks": (
        "path varchar, job varchar",
        [
            ('.github/workflows/check.yml', 'Lint all'),
            ('.github/workflows/check.yml', 'shared'),
            ('.github/workflows/merge.yml', 'merge'),
        ],
    ),
    "command_roots": (
        "step int, segment int, depth int, program varchar, arguments varchar, package_roots varchar",
        [
            (2, 0, 0, 'cog', 'check', ''),
            (2, 1, 0, 'cargo', 'clippy', 'crates/a,tools/far'),
            (3, 0, 0, 'cargo', 'test', 'app/parts/one'),
            (3, 0, 1, 'jest', '--fast -- now', 'app/parts/one'),
            (3, 1, 0, 'npm', 'run ci -- --fast -- now', 'app/parts/one'),
        ],
    ),
    "tool_invocations": (
        "tool varchar, path varchar, job varchar, step int, source varchar, runs_on_changes boolean",
        [
            ('cargo', '.github/workflows/check.yml', 'lint', 2, 'command', True),
            ('cargo', '.github/workflows/check.yml', 'lint', 3, 'command', True),
            ('codespell', '.github/workflows/check.yml', 'lint', 0, 'github-action', True),
            ('javascript-test-runner', '.github/workflows/check.yml', 'lint', 3, 'command', True),
        ],
    ),
    "commit_enforcements": (
        "path varchar, job varchar, step int, enforcer varchar, target varchar",
        [
            ('.github/workflows/check.yml', 'lint', 1, 'commitlint', 'commit-message'),
            ('.github/workflows/check.yml', 'lint', 2, 'cocogitto', 'commit-message'),
            ('.github/workflows/title.yaml', 'title', 0, 'conventional-pr-title-pattern', 'pull-request-title'),
            ('.github/workflows/title.yaml', 'title', 1, 'semantic-pull-request', 'pull-request-title'),
        ],
    ),
    "automerge_facts": (
        "path varchar, pull_request_trigger boolean, dependabot_only boolean, excludes_major_updates boolean, fetches_metadata boolean, enables_auto_merge boolean",
        [
            ('.github/workflows/check.yml', True, False, False, False, False),
            ('.github/workflows/merge.yml', True, True, True, True, True),
            ('.github/workflows/title.yaml', True, False, False, False, False),
        ],
    ),
    "action_publication": (
        "path varchar, name varchar, slug varchar, url varchar, readme_path varchar, linked boolean, bad boolean",
        [
            ('action.yml', 'My Great Action!', 'my-great-action', 'https://github.com/marketplace/actions/my-great-action', 'README.md', True, False),
            ('x/action.yml', '!!', None, None, 'README.md', False, True),
            ('y/action.yml', None, None, None, 'README.md', False, True),
        ],
    ),
    "updater_ecosystems": (
        "path varchar, ecosystem varchar, directories varchar, serves varchar, bad boolean",
        [
            ('.github/dependabot.yaml', 'npm', '/a,/b', 'bun', False),
            ('.github/dependabot.yaml', 'npm', '/a,/b', 'npm', False),
            ('.github/dependabot.yaml', 'npm', '/a,/b', 'pnpm', False),
            ('.github/dependabot.yaml', 'npm', '/a,/b', 'yarn', False),
            ('.github/dependabot.yaml', None, '', None, True),
        ],
    ),
    "managed_workflows": (
        "path varchar, managed boolean, gating boolean",
        [
            ('.github/workflows/a.yml', False, False),
            ('b', False, False),
            ('c', False, True),
            ('dynamic/pages/x', True, True),
        ],
    ),
    "packages_inventory": (
        "id varchar, name varchar, ecosystem varchar, workspace_root varchar, lockfile varchar, n_dependencies int, n_scripts int",
        [
            ('cargo:.', 'top', 'cargo', '', 'Cargo.lock', 2, 0),
            ('cargo:crates/own', 'own', 'cargo', '', 'Cargo.lock', 0, 0),
            ('node:web', 'web', 'pnpm', 'web', 'web/pnpm-lock.yaml', 1, 4),
            ('node:web/packages/p', 'p', 'pnpm', 'web', 'web/pnpm-lock.yaml', 0, 0),
        ],
    ),
    "package_owners": (
        "path varchar, package varchar",
        [
            ('.github/dependabot.yml', 'cargo:.'),
            ('.github/workflows/ci.yml', 'cargo:.'),
            ('Cargo.lock', 'cargo:.'),
            ('Cargo.toml', 'cargo:.'),
            ('bad/package.json', 'cargo:.'),
            ('crates/own/Cargo.toml', 'cargo:crates/own'),
            ('crates/own/src/lib.rs', 'cargo:crates/own'),
            ('src/main.rs', 'cargo:.'),
            ('web/package.json', 'cargo:.'),
            ('web/package.json', 'node:web'),
            ('web/packages/p/package.json', 'cargo:.'),
            ('web/packages/p/package.json', 'node:web/packages/p'),
            ('web/pnpm-lock.yaml', 'cargo:.'),
            ('web/pnpm-lock.yaml', 'node:web'),
            ('web/src/a.ts', 'cargo:.'),
            ('web/src/a.ts', 'node:web'),
        ],
    ),
    "package_languages": (
        "package varchar, language varchar, evidence varchar",
        [
            ('cargo:.', 'rust', 'Cargo.toml,src/main.rs'),
            ('cargo:.', 'typescript', 'web/src/a.ts'),
            ('cargo:crates/own', 'rust', 'crates/own/Cargo.toml,crates/own/src/lib.rs'),
            ('node:web', 'javascript', 'web/package.json'),
            ('node:web', 'typescript', 'web/src/a.ts'),
            ('node:web/packages/p', 'javascript', 'web/packages/p/package.json'),
        ],
    ),
    "projects_inventory": (
        "root varchar, languages varchar",
        [
            ('', 'rust'),
            ('crates/own', 'rust'),
            ('web', 'javascript,typescript'),
            ('web/packages/p', 'javascript'),
        ],
    ),
    "artifacts_inventory": (
        "profile varchar, root varchar, evidence varchar",
        [
            ('binary', '', 'Cargo.toml,src/main.rs'),
            ('binary', 'crates/own', 'crates/own/Cargo.toml'),
            ('site', 'web', 'web/package.json,web/src/a.ts'),
        ],
    ),
    "inventory_diagnostics": (
        "kind varchar, path varchar",
        [
            ('manifest', 'bad/package.json'),
        ],
    ),
    "workflow_tasks": (
        "path varchar, job varchar, tool varchar, task varchar, depth int",
        [
            ('.github/workflows/ci.yml', 'test', 'cargo', 'format', 0),
            ('.github/workflows/ci.yml', 'test', 'cargo', 'test', 0),
            ('.github/workflows/ci.yml', 'test', 'javascript-linter', 'lint', 2),
            ('.github/workflows/ci.yml', 'test', 'javascript-test-runner', 'test', 2),
        ],
    ),
    "dependency_updates": (
        "path varchar, ecosystem varchar, directories varchar, interval varchar",
        [
            ('.github/dependabot.yml', 'cargo', '/', 'weekly'),
        ],
    ),
    "rewrites_applied": (
        "path varchar, rewritten varchar, rewrites varchar, narrowed boolean, same_length boolean",
        [
            ('a.rs', 'pub       trait A {}\nimpl       Default for X {}\nfn f() { let x = &          y;        g();     { 1 } }\nconst X: u8 = 1;', 'Blank:const,Blank:const,Blank:become,Blank:raw const,Blank:try', False, True),
            ('b.py', '     import os\nx = lazy\n         from a import b\nlazy_import = 1', 'Blank:lazy,Blank:lazy', False, True),
            ('c.c', 'static int f(int a       )\n{\n\t                       if(item, list) {}\n}\n                       \n      \nx = container_of(p, 0         , member);\nva_arg(ap, 0     );\n#define UNUSED x UNUSED\n', 'Blank:UNUSED,CallToIf:for_each_string_list_item,BlankInvocation:GIT_PATH_FUNC,TypeArgument:container_of,ZeroArgument:va_arg', True, True),
            ('d.zig', 'fn f(x: u16               ) void {}\nconst y = if (a) 1 else 2;\nreturn !if (x) y else z;', 'TypeCondition:if', True, True),
            ('e.c', 'int UNUSED_x(void);\nint é       ;\n', 'Blank:UNUSED', False, True),
            ('f.go', None, '', False, None),
        ],
    ),
    "rewrite_rules": (
        "language varchar, rule varchar, n bigint",
        [
            ('c', 'Blank', 20),
            ('c', 'BlankInvocation', 21),
            ('c', 'CallToIf', 14),
            ('c', 'TypeArgument', 10),
            ('c', 'ZeroArgument', 2),
            ('python', 'Blank', 2),
            ('rust', 'Blank', 10),
            ('zig', 'TypeCondition', 1),
        ],
    ),
    "parser_packs": (
        "id varchar, language varchar, root varchar, extensions varchar, queries varchar, queries_sha256 varchar",
        [
            ('python', 'python', 'single', '', '', None),
            ('rust', 'rust', 'packs/rust', 'rs', 'a,b', '02a80f9543ab2d554fc5ceffd6f0e9418a01ac3b012dd86a2003c791e0f8d39c'),
            ('rust-general', 'rust', 'packs/rust2', '', 'a', 'af392258b29accd29f0515b9d6487afd7201c17e278e51dce399ae2871d2e222'),
        ],
    ),
    "parser_pack_errors": (
        "root varchar, error varchar",
        [
            ('packs/new', 'unsupported schema 2'),
            ('packs/odd', 'invalid selector .py'),
            ('packs/rust3', 'claims the files of rust'),
            ('packs/strange', 'unknown language klingon'),
            ('packs/wrong', "the grammar's digest differs"),
        ],
    ),
    "parser_resolution": (
        "path varchar, language varchar, pack varchar",
        [
            ('build.rs', 'rust', 'rust'),
            ('c.py', 'python', 'python'),
            ('d.zig', 'zig', None),
            ('x/a.rs', 'rust', 'rust'),
            ('x/b.rs.in', 'rust', 'rust-general'),
        ],
    ),
    "parser_differences": (
        "first varchar, second varchar, difference varchar",
        [
            ('rust', 'rust-general', 'rust-general ships no b'),
        ],
    ),
    "parser_vocabulary": (
        "id varchar, language varchar, topic varchar, word varchar",
        [
            ('python', 'python', 'propagation', 'declared'),
            ('rust', 'rust', 'fallible_types', 'Result'),
            ('rust', 'rust', 'markers', 'test'),
            ('rust', 'rust', 'propagation', 'declared'),
            ('rust-general', 'rust', 'propagation', 'declared'),
        ],
    ),
    "corpus_samples": (
        "language varchar, task varchar, lines bigint, bytes bigint, layout varchar",
        [
            ('c', 'Sum', 2, 12, 'rosetta'),
            ('python', 'Sum', 1, 5, 'rosetta'),
            ('python', 'interpreter', 2, 10, 'mal'),
            ('python', 'one', 1, 5, 'exercism'),
            ('rust', 'interpreter', 1, 12, 'mal'),
            ('rust', 'one', 2, 18, 'exercism'),
            ('shell', 'Max', 1, 4, 'rosetta'),
        ],
    ),
    "corpus_layouts": (
        "layout varchar, prefix varchar",
        [
            ('exercism', 'rust'),
            ('mal', 'impls'),
            ('rosetta', ''),
            ('rosetta', 'Task'),
        ],
    ),
    "published_index": (
        "language varchar, lines double, bytes double",
        [
            ('c', 1.0, 1.0),
            ('c-sharp', 0.5795, 0.6409),
            ('cpp', 0.8393, 0.8892),
            ('go', 0.6851, 0.5767),
            ('java', 0.7084, 0.8213),
            ('javascript', 0.527, 0.5369),
            ('kotlin', 0.362, 0.5086),
            ('php', 0.647, 0.6077),
            ('python', 0.3185, 0.4069),
            ('ruby', 0.5279, 0.4286),
            ('rust', 0.607, 0.5937),
            ('scala', 0.3954, 0.5383),
            ('shell', 0.5232, 0.4484),
            ('swift', 0.5654, 0.5842),
            ('typescript', 0.6111, 0.6375),
            ('zig', 0.6357, 0.6632),
        ],
    ),
    "compiler_observation": (
        "version varchar, commit varchar, host varchar, sysroot varchar, cfg varchar, target_features varchar, error varchar",
        [
            ('1', None, 'x', '', '', '', 'no sysroot'),
            ('1.80.0', None, 'x86_64', '/t', 'unix', '', None),
            ('1.80.0', None, None, '/t', '', '', 'no host in the version'),
            ('1.93.1', '01f4d6f7f', 'aarch64-apple-darwin', '/toolchains/stable', 'target_arch="aarch64",target_feature="aes",target_feature="neon"', 'aes,neon', None),
            (None, None, None, '/t', '', '', 'no release in the version'),
        ],
    ),
    "first_errors": (
        "path varchar, line int, message varchar",
        [
            ('a.rs', 2, "line 2: the grammar can't read `become g()`"),
            ('b.rs', 1, "line 1: the grammar can't read `become g()`"),
            ('c.rs', 7, "line 7: the grammar can't read `xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx`"),
        ],
    ),
    "parse_rate": (
        "files bigint, bytes bigint, units bigint, rewritten bigint, errored bigint, unreadable_bytes bigint, dropped_bytes bigint, errored_percent double",
        [
            (4, 200, 6, 2, 3, 99, 170, 75.0),
        ],
    ),
    "error_heads": (
        "message varchar, n bigint",
        [
            ("the grammar can't read `become g()`", 2),
            ("the grammar can't read `xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx`", 1),
        ],
    ),
    "container_kinds": (
        "node varchar, modifier varchar, kind varchar, external boolean",
        [
            ('block', None, None, False),
            ('enum_declaration', 'extern', 'enum', False),
            ('opaque_declaration', None, 'opaque', False),
            ('struct_declaration', 'extern', 'extern struct', True),
            ('struct_declaration', None, 'struct', False),
            ('union_declaration', 'packed', 'packed union', False),
        ],
    ),
    "receivers": (
        "name varchar, container varchar, written varchar, receiver boolean, frees boolean",
        [
            ('deinit', 'Foo', None, False, False),
            ('deinit', 'a.Foo', '*Foo', True, True),
            ('deinit', 'a.Foo', '?*const Foo', True, True),
            ('destroy', 'a.Foo', 'Bar', False, False),
            ('finalize', '', 'Foo', False, False),
            ('init', 'a.Foo', '@This()', True, False),
        ],
    ),
    "locals_and_calls": (
        "written varchar, value varchar, receiver varchar, container varchar, tail varchar",
        [
            ('', 'Ctx{ .a = 1 }', 'self.list.?items', 'Ctx', 'items'),
            ('', 'f(x) { }', 'a', None, 'a'),
            ('', 'none', '*p.&q', None, 'q'),
            ('?*const a.B', 'x', '&map', 'a.B', 'map'),
        ],
    ),
    "argument_binding": (
        "callee varchar, index int, text varchar, parameter varchar, written varchar",
        [
            ('f', 0, 'x', 'self', '*Foo'),
            ('f', 1, 'y', 'n', 'u8'),
            ('f', 2, 'z', None, None),
            ('g', 0, 'w', None, None),
        ],
    ),
    "entity_ids": (
        "file varchar, id varchar",
        [
            ('/a/node_modules/@t/p/i.d.ts', 'pkg:@t/p:P.q'),
            ('/a/node_modules/b/node_modules/c/i.ts', 'pkg:c:c'),
            ('/a/src/m.ts', 'src/m.ts:5:7'),
            ('/x/lib.es5.d.ts', 'lib:Array.filter'),
        ],
    ),
    "dispatch_order": (
        "dispatch varchar, rank int",
        [
            ('odd', 3),
            ('static', 0),
            ('unknown', 3),
            ('unmonomorphized', 2),
            ('virtual', 1),
        ],
    ),
    "observation_documents": (
        "name varchar, rows bigint",
        [
            ('bad', 2),
            ('call_edges', 2),
            ('definitions', 2),
            ('gaps', 1),
            ('implements', 0),
            ('references', 0),
            ('types', 0),
            ('units', 1),
        ],
    ),
    "merge_provenance": (
        "unit varchar, toolchain varchar, provider varchar, definitions boolean, references boolean, call_edges boolean",
        [
            ('all', 't1', 'p', True, False, False),
        ],
    ),
    "invocations": (
        "line varchar, program varchar, arguments varchar",
        [
            ('/usr/bin/pnpm exec eslint .', 'eslint', '.'),
            ('=x y', '=x', 'y'),
            ('A=b', None, None),
            ('FOO=1 BAR=2 cargo test', 'cargo', 'test'),
            ('bunx', 'bunx', ''),
            ('env A=b npx vitest run', 'vitest', 'run'),
            ('npm exec', 'npm', 'exec'),
            ('npm run test -- --watch', 'npm', 'run test -- --watch'),
            ('sudo -E -n apt-get install x', 'apt-get', 'install x'),
            ('yarn dlx tsc', 'tsc', ''),
        ],
    ),
    "type_shapes": (
        "written varchar, optional boolean, constant boolean, many boolean, slice boolean, pointer boolean, pointee varchar",
        [
            ('*Bar', False, False, False, False, True, 'Bar'),
            ('*align(8) const X', False, True, False, False, True, 'X'),
            ('?*const Foo', True, True, False, False, True, 'Foo'),
            ('?[]const T', True, True, False, True, True, 'T'),
            ('Foo', False, False, False, False, False, None),
            ('[*]const u8', False, True, True, False, True, 'u8'),
            ('[:0]const u8', False, True, False, True, True, 'u8'),
            ('[]u8', False, False, False, True, True, 'u8'),
            ('u32', False, False, False, False, False, None),
        ],
    ),
    "codeowners_rules": (
        "line_no int, pattern varchar, owners varchar",
        [
            (2, '*', '@org/team a@b.co'),
            (3, '/docs/', ''),
            (9, 'lib/', '@user'),
        ],
    ),
    "codeowners_diagnostics": (
        "path varchar, line_no int, message varchar",
        [
            ('CODEOWNERS', 4, 'unsupported pattern'),
            ('CODEOWNERS', 5, 'unsupported pattern'),
            ('CODEOWNERS', 7, 'invalid owner'),
            ('CODEOWNERS', 8, 'unsupported pattern'),
        ],
    ),
    "generated_directories": (
        "path varchar",
        [
            ("web/build",),
            ("web/src/build",),
            ("x/__pycache__",),
            ("x/target",),
        ],
    ),
    "update_errors": (
        "n int, ecosystem varchar, error varchar",
        [
            (0, None, "a list of updates is due"),
            (1, None, "version must be 2"),
            (2, None, "update 1 must be a mapping"),
            (3, None, "update 1 needs a directory or directories, not both"),
            (4, None, "update 1 needs directories that are texts"),
            (5, None, "update 2 needs an ecosystem"),
            (6, None, "update 1 needs a schedule with an interval"),
            (7, None, "update 1 needs directories that are texts"),
        ],
    ),
}
