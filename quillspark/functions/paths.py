"""Path rules: globs and file eligibility."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

MOST_CHARS, MOST_SEGMENTS = 512, 64
# What a snapshot leaves out and takes in.
EXCLUDED_DIRECTORIES = [
    ".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit", "coverage", ".venv", "venv",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".gradle",
]
BINARY_EXTENSIONS = [
    "7z", "a", "avi", "bin", "bmp", "class", "dll", "dmg", "doc", "docx", "eot", "exe", "flac", "gif", "gz", "ico", "jar", "jpeg", "jpg",
    "m4a", "mkv", "mov", "mp3", "mp4", "o", "obj", "ogg", "otf", "pdf", "png", "pyc", "so", "sqlite", "sqlite3", "tar", "tif", "tiff",
    "ttf", "wav", "webm", "webp", "woff", "woff2", "xls", "xlsx", "xz", "zip", "zst",
]
LOCK_FILES = [
    "bun.lock", "bun.lockb", "cargo.lock", "composer.lock", "deno.lock", "flake.lock", "gemfile.lock", "go.sum", "mix.lock",
    "package-lock.json", "pnpm-lock.yaml", "podfile.lock", "poetry.lock", "yarn.lock",
]
SECRET_NAMES = [
    ".env", ".netrc", ".npmrc", ".pgpass", ".pypirc", "credentials", "credentials.json", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa",
]
SECRET_EXTENSIONS = [
    "csr", "der", "jks", "key", "keystore", "p12", "pem", "pfx",
]
TEXT_EXTENSIONS = [
    "rs", "ts", "tsx", "js", "jsx", "sql", "md", "mdx", "rst", "txt",
]
DEFAULT_NAMES = [
    "cargo.toml", "package.json",
]
# Languages by whole file name (in lower case), then by extension.
LANGUAGE_NAMES = {
    "dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "justfile": "makefile",
    "kbuild": "makefile", "cmakelists.txt": "cmake", "jenkinsfile": "groovy", "rakefile": "ruby", "gemfile": "ruby", "podfile": "ruby",
    "cartfile": "ruby", "fastfile": "ruby", "brewfile": "ruby", "vagrantfile": "ruby", "berksfile": "ruby", "guardfile": "ruby",
    "capfile": "ruby", "thorfile": "ruby", "appfile": "ruby", "snapfile": "ruby", ".gitignore": "gitconfig", ".gitattributes": "gitconfig",
    ".gitmodules": "gitconfig", ".editorconfig": "editorconfig", ".env": "dotenv",
}
LANGUAGE_EXTENSIONS = {
    "rs": "rust", "toml": "toml", "py": "python", "pyi": "python", "rb": "ruby", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "vue": "vue",
    "svelte": "svelte", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "swift": "swift",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "m": "objc", "mm": "objcpp",
    "php": "php", "pl": "perl", "pm": "perl", "lua": "lua", "r": "r", "R": "r", "dart": "dart", "ex": "elixir", "exs": "elixir",
    "erl": "erlang", "hrl": "erlang", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "fs": "fsharp", "fsx": "fsharp", "clj": "clojure",
    "cljs": "clojure", "cljc": "clojure", "groovy": "groovy", "zig": "zig", "nim": "nim", "cr": "crystal", "sol": "solidity", "elm": "elm",
    "purs": "purescript", "re": "reason", "res": "reason", "gd": "gdscript", "sql": "sql", "graphql": "graphql", "gql": "graphql",
    "proto": "protobuf", "prisma": "prisma", "tf": "terraform", "tfvars": "terraform", "tftpl": "terraform", "hcl": "hcl", "nix": "nix",
    "yaml": "yaml", "yml": "yaml", "json": "json", "jsonc": "json", "json5": "json", "ini": "ini", "cfg": "ini", "conf": "ini",
    "properties": "ini", "xml": "xml", "xsd": "xml", "xsl": "xml", "html": "html", "htm": "html", "css": "css", "scss": "scss",
    "sass": "scss", "less": "less", "md": "markdown", "mdx": "markdown", "rst": "restructuredtext", "txt": "text", "po": "gettext",
    "pot": "gettext", "svg": "svg", "ipynb": "jupyter", "sh": "shell", "bash": "shell", "zsh": "shell", "ksh": "shell", "fish": "fish",
    "ps1": "powershell", "psm1": "powershell", "bat": "batch", "cmd": "batch", "asm": "assembly", "s": "assembly", "f90": "fortran",
    "f95": "fortran", "f03": "fortran", "pas": "pascal", "v": "verilog", "sv": "verilog", "svh": "verilog", "vhd": "vhdl", "vhdl": "vhdl",
    "tex": "latex", "diff": "diff", "patch": "diff", "env": "dotenv", "mk": "makefile",
}
# Kinds of library files by extension.
FILE_KINDS = {"txt": "text", "md": "text", "json": "text", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "pdf": "document", "docx": "document", "xlsx": "document"}


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: * and ? stay in a segment, ** crosses any number of them; without a slash any segment may
    match. Empty and overlong patterns match nothing."""
    pattern = pattern.lstrip("/")
    if not pattern or len(pattern) > MOST_CHARS or pattern.count("/") >= MOST_SEGMENTS:
        return "(?!)"
    out, i = "", 0
    while i < len(pattern):
        if pattern[i:] == "/**":
            out, i = out + "(?:/.*)?", i + 3
        elif pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i])
            i += 1
    return f"^{out}$" if "/" in pattern else f"(?:^|/){out}(?:/|$)"


def selection(path: Column, size: Column, excludes: tuple[str, ...] = (), includes: tuple[str, ...] = (), most_bytes: int = 8 << 20) -> Column:
    """Decision for a file, the first rule that applies."""
    name, parts = F.lower(F.element_at(F.split(path, "/"), -1)), F.split(path, "/")
    extension = F.regexp_extract(name, r"\.([^.]*)$", 1)
    matches = lambda patterns: F.lit(False) if not patterns else path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED_DIRECTORIES))), "excluded_directory")
        .when(name.isin(*SECRET_NAMES) | name.startswith(".env."), "secret")
        .when(name.isin(*LOCK_FILES), "lockfile")
        .when(name.contains(".min."), "minified")
        .when(extension == "map", "source_map")
        .when(extension == "lock", "lockfile")
        .when(extension.isin(*SECRET_EXTENSIONS), "secret")
        .when(extension.isin(*BINARY_EXTENSIONS), "binary")
        .when(size > most_bytes, "too_large")
        .when(matches(excludes), "excluded_by_user")
        .when(extension.isin(*TEXT_EXTENSIONS) | name.isin(*DEFAULT_NAMES) | matches(includes), "eligible")
        .otherwise("not_included")
    )


def language_of(path: Column) -> Column:
    """Language by file name, else by extension (a leading dot begins none), else unknown."""
    table = lambda t: F.create_map(*[F.lit(x) for pair in t.items() for x in pair])
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.coalesce(F.try_element_at(table(LANGUAGE_NAMES), F.lower(name)), F.try_element_at(table(LANGUAGE_EXTENSIONS), extension), F.lit("unknown"))


def file_kind(path: Column, media_type: Column | None = None) -> Column:
    """text, image or document by the extension, or text by a declared media type of text or JSON; else invalid."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for pair in FILE_KINDS.items() for x in pair]), extension)
    declared = F.lit(None).cast("string") if media_type is None else F.when(F.lower(media_type).rlike(r"^(text/|application/json(;|$))"), "text")
    return F.coalesce(by_name, declared, F.lit("invalid"))
