"""Fixed values that results depend on. Plain tables, nothing computed."""

# fixed values: extension -> language
EXTENSION_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".cpp": "C++",
    ".c": "C", ".h": "C/C++", ".hpp": "C++", ".cs": "C#", ".php": "PHP", ".rb": "Ruby",
    ".go": "Go", ".rs": "Rust", ".kt": "Kotlin", ".swift": "Swift", ".scala": "Scala",
    ".r": "R", ".m": "Objective-C", ".sh": "Shell", ".bash": "Bash", ".ps1": "PowerShell",
    ".bat": "Batch", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass",
    ".xml": "XML", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".sql": "SQL",
    ".dockerfile": "Dockerfile", ".makefile": "Makefile", ".md": "Markdown", ".tex": "LaTeX",
    ".vim": "Vim", ".lua": "Lua", ".pl": "Perl", ".dart": "Dart", ".elm": "Elm",
    ".ex": "Elixir", ".clj": "Clojure", ".hs": "Haskell", ".ml": "OCaml", ".f90": "Fortran",
}

# fixed values: suffixes of binary files
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".a", ".o", ".obj", ".lib",
    ".jar", ".war", ".ear", ".class", ".pyc", ".pyo", ".pyd",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".svg", ".webp",
    ".mp3", ".wav", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".bz2", ".rar", ".7z", ".deb", ".rpm",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    # media, archive and object types that every MIME table knows
    ".tif", ".tiff", ".avif", ".heic", ".aac", ".aif", ".aiff", ".ogg", ".opus", ".m4a",
    ".mpg", ".mpeg", ".webm", ".m4v", ".swf", ".bin", ".iso", ".tgz", ".wasm", ".ps", ".eps",
)

# fixed values: configuration files
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".xml", ".ini", ".toml", ".cfg")
CONFIG_NAMES = ("config", "configuration", "settings", "dockerfile", "makefile")

# fixed values: documentation
DOC_EXTENSIONS = (".md", ".rst", ".txt", ".docx")
DOC_DIRECTORIES = ("doc", "docs", "documentation")

# fixed values: whole words that mark a bug-fix or a feature commit
FIX_WORDS = ("fix", "fixes", "fixed", "bug", "repair", "correct", "patch", "resolve")
FEATURE_WORDS = ("feature", "feat", "add", "adds", "added", "implement", "implements",
                 "implemented", "create", "creates", "created", "introduce", "introduces",
                 "introduced")

# fixed values: (topic, substrings, substring that bars the rule), first match wins
TOPIC_RULES = (
    ("Package Management",
     ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock"), None),
    ("Core Logic", (".js", ".ts", ".py"), "test"),
    ("Configuration", (".yml", ".yaml", ".json", "dockerfile", "makefile"), None),
    ("UI/Frontend", (".css", ".html", ".vue", ".jsx", ".tsx"), None),
    ("Documentation", ("readme", "changelog", ".md"), None),
)

# fixed values: language -> role in a project
LANGUAGE_ROLE = {
    "JavaScript": "Core application logic", "TypeScript": "Type-safe application code",
    "JSON": "Configuration and data", "YAML": "Configuration files",
    "CSS": "User interface styling", "HTML": "User interface structure",
    "Python": "Scripts and utilities", "Shell": "Build and deployment",
    "Dockerfile": "Containerization", "Markdown": "Documentation",
}
DEFAULT_ROLE = "Supporting files"

# fixed values: hints given for a set of minor languages
MINOR_LANGUAGE_HINTS = (
    (("Python", "Shell", "Batch"), "build/deployment scripts"),
    (("Java", "C++", "C"), "legacy components or dependencies"),
    (("LaTeX", "Markdown"), "documentation"),
)
DEFAULT_MINOR_HINT = "specialized tools, legacy code, or project infrastructure"

# fixed values: contributor tiers, (label, fewest commits), highest first
CONTRIBUTOR_TIERS = (("Core (100+)", 100), ("Active (21-100)", 21), ("Regular (6-20)", 6),
                     ("Casual (1-5)", 0))

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# fixed values: branches tried in this order
BRANCH_PRIORITY = ("main", "master", "develop")
