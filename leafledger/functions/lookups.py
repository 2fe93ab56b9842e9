"""Extension, syntax and status tables (keys without a dot)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are text whatever the content.
TEXT_EXTENSIONS = (
    "txt", "md", "markdown", "rst", "asciidoc", "json", "xml", "yaml", "yml", "toml", "ini",
    "cfg", "conf", "log", "csv", "tsv", "sql", "html", "htm", "css", "js", "ts", "jsx", "tsx",
    "go", "py", "java", "c", "cpp", "h", "hpp", "cs", "php", "rb", "rs", "kt", "swift", "sh",
    "bash", "zsh", "fish", "ps1", "bat", "cmd", "dockerfile", "gitignore", "gitattributes",
)

# Extension -> language name.
LANGUAGES = {
    "go": "Go",
    "html": "HTML", "htm": "HTML",
    "css": "CSS", "scss": "CSS", "sass": "CSS", "less": "CSS",
    "js": "JavaScript", "jsx": "JavaScript",
    "ts": "TypeScript", "tsx": "TypeScript",
    "c": "C", "h": "C",
    "cpp": "C++", "hpp": "C++", "cc": "C++", "cxx": "C++", "c++": "C++",
    "cs": "C#",
    "java": "Java",
    "kt": "Kotlin", "kts": "Kotlin",
    "scala": "Scala",
    "groovy": "Groovy",
    "py": "Python", "pyc": "Python", "pyd": "Python", "pyo": "Python", "pyw": "Python",
    "rb": "Ruby", "erb": "Ruby",
    "php": "PHP",
    "swift": "Swift",
    "rs": "Rust",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell",
    "json": "JSON",
    "yaml": "YAML", "yml": "YAML",
    "xml": "XML",
    "toml": "TOML",
    "csv": "CSV", "tsv": "CSV",
    "md": "Markdown", "markdown": "Markdown",
    "txt": "Text", "rst": "Text",
    "ini": "Config", "cfg": "Config", "conf": "Config",
    "pdf": "Document", "doc": "Document", "docx": "Document", "odt": "Document",
    "png": "Image", "jpg": "Image", "jpeg": "Image", "gif": "Image", "svg": "Image", "webp": "Image",
    "ico": "Image",
    "mp3": "Audio", "wav": "Audio", "ogg": "Audio",
    "mp4": "Video", "webm": "Video", "avi": "Video",
    "zip": "Archive", "tar": "Archive", "gz": "Archive", "rar": "Archive", "7z": "Archive",
}
OTHER_LANGUAGE = "Other"

# Extension -> fence identifier.
FENCES = {
    "go": "go",
    "js": "javascript",
    "ts": "typescript",
    "py": "python",
    "java": "java",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp",
    "php": "php",
    "rb": "ruby",
    "rs": "rust",
    "kt": "kotlin",
    "swift": "swift",
    "scala": "scala",
    "sh": "bash", "bash": "bash", "zsh": "bash", "fish": "bash",
    "ps1": "powershell",
    "sql": "sql",
    "html": "html", "htm": "html",
    "xml": "xml",
    "css": "css",
    "scss": "scss",
    "sass": "sass",
    "less": "less",
    "json": "json",
    "yaml": "yaml", "yml": "yaml",
    "toml": "toml",
    "ini": "ini", "cfg": "ini", "conf": "ini",
    "md": "markdown",
    "txt": "text", "log": "text",
    "gitignore": "gitignore",
    "dockerfile": "dockerfile",
    "makefile": "makefile",
}

# Extension -> comment syntax: (line prefix, block start, block end).
COMMENT_SYNTAX = {
    "go": ("//", "/*", "*/"), "c": ("//", "/*", "*/"), "cpp": ("//", "/*", "*/"),
    "java": ("//", "/*", "*/"), "js": ("//", "/*", "*/"), "ts": ("//", "/*", "*/"),
    "cs": ("//", "/*", "*/"), "php": ("//", "/*", "*/"), "swift": ("//", "/*", "*/"),
    "py": ("#", None, None), "rb": ("#", None, None), "sh": ("#", None, None),
    "bash": ("#", None, None),
    "sql": ("--", "/*", "*/"),
    "html": (None, "<!--", "-->"), "xml": (None, "<!--", "-->"),
}

# Token family -> extensions; everything else is counted by bytes.
TOKEN_FAMILIES = {
    "code": ("go", "java", "c", "cpp", "cc", "cxx", "h", "hpp"),
    "script": ("js", "ts", "py", "rb", "php", "cs", "kt", "swift", "rs"),
    "data": ("json", "xml", "yaml", "yml", "toml"),
    "text": ("md", "txt", "rst"),
}

STATUS_TEXT = {
    "??": "Untracked",
    "A ": "Added",
    " M": "Modified (not staged)",
    "M ": "Modified (staged)",
    "MM": "Modified (partially staged)",
    "D ": "Deleted (staged)",
    " D": "Deleted (not staged)",
    "R ": "Renamed",
    "C ": "Copied",
    "UU": "Conflict",
}


def one_of(value: Column, names: tuple[str, ...]) -> Column:
    """Membership in a fixed list of names; null stays null."""
    return value.isin(*names)


def map_column(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def language_table(spark: SparkSession) -> DataFrame:
    """``(ext_key, language)``: a fixed table of 73 rows, always small enough to broadcast."""
    rows = list(LANGUAGES.items())
    return spark.createDataFrame(rows, "ext_key string, language string")


def fence_of(ext: Column) -> Column:
    """Fence identifier of an extension given with its dot and in its own case."""
    bare = F.substring_index(ext, ".", -1)
    known = F.try_element_at(map_column(FENCES), bare)
    return F.when(ext == "", "").otherwise(F.coalesce(known, bare))
