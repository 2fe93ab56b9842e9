"""Expected values for the SQL equivalents, stated apart from the code that they check."""

from __future__ import annotations

BUDGET = 1_000_000
CONVERSATION_BUDGET = 1500
# Bytes of the ten quotas that the query deals out, None where one is invalid.
QUOTA_BYTES = (512, 2048, 4096, 1048576, 0, None, None, 0, None, 3000)

# Unicode white space.
SPACES = "".join(map(chr, (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))

TEXT_EXTENSIONS = (
    "asciidoc", "bash", "bat", "c", "cfg", "cmd", "conf", "cpp", "cs", "css", "csv", "dockerfile",
    "fish", "gitattributes", "gitignore", "go", "h", "hpp", "htm", "html", "ini", "java", "js",
    "json", "jsx", "kt", "log", "markdown", "md", "php", "ps1", "py", "rb", "rs", "rst", "sh",
    "sql", "swift", "toml", "ts", "tsv", "tsx", "txt", "xml", "yaml", "yml", "zsh",
)

# Language -> extensions.
LANGUAGES = {
    "Go": ("go",),
    "HTML": ("html", "htm"),
    "CSS": ("css", "scss", "sass", "less"),
    "JavaScript": ("js", "jsx"),
    "TypeScript": ("ts", "tsx"),
    "C": ("c", "h"),
    "C++": ("cpp", "hpp", "cc", "cxx", "c++"),
    "C#": ("cs",),
    "Java": ("java",),
    "Kotlin": ("kt", "kts"),
    "Scala": ("scala",),
    "Groovy": ("groovy",),
    "Python": ("py", "pyc", "pyd", "pyo", "pyw"),
    "Ruby": ("rb", "erb"),
    "PHP": ("php",),
    "Swift": ("swift",),
    "Rust": ("rs",),
    "Shell": ("sh", "bash", "zsh"),
    "JSON": ("json",),
    "YAML": ("yaml", "yml"),
    "XML": ("xml",),
    "TOML": ("toml",),
    "CSV": ("csv", "tsv"),
    "Markdown": ("md", "markdown"),
    "Text": ("txt", "rst"),
    "Config": ("ini", "cfg", "conf"),
    "Document": ("pdf", "doc", "docx", "odt"),
    "Image": ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico"),
    "Audio": ("mp3", "wav", "ogg"),
    "Video": ("mp4", "webm", "avi"),
    "Archive": ("zip", "tar", "gz", "rar", "7z"),
}

# Fence identifier -> extensions that differ from it or are named by it.
FENCES = {
    "go": ("go",),
    "javascript": ("js",),
    "typescript": ("ts",),
    "python": ("py",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp"),
    "csharp": ("cs",),
    "php": ("php",),
    "ruby": ("rb",),
    "rust": ("rs",),
    "kotlin": ("kt",),
    "swift": ("swift",),
    "scala": ("scala",),
    "bash": ("sh", "bash", "zsh", "fish"),
    "powershell": ("ps1",),
    "sql": ("sql",),
    "html": ("html", "htm"),
    "xml": ("xml",),
    "css": ("css",),
    "scss": ("scss",),
    "sass": ("sass",),
    "less": ("less",),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "ini": ("ini", "cfg", "conf"),
    "markdown": ("md",),
    "text": ("txt", "log"),
    "gitignore": ("gitignore",),
    "dockerfile": ("dockerfile",),
    "makefile": ("makefile",),
}

# Line mark, block start and block end, and the extensions that use them.
COMMENTS = (
    (("//", "/*", "*/"), ("go", "c", "cpp", "java", "js", "ts", "cs", "php", "swift")),
    (("#", None, None), ("py", "rb", "sh", "bash")),
    (("--", "/*", "*/"), ("sql",)),
    ((None, "<!--", "-->"), ("html", "xml")),
)

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
