"""Word lists, tables and constants whose results must equal a known system's.

Everything here is data, in its natural order.  All logic is elsewhere.
"""

# Kinds, relations, languages.
SYMBOL_KINDS = ("function", "class", "method", "interface", "variable", "type", "import", "export")
RELATIONS = ("calls", "imports", "inherits", "implements", "references", "defines", "contains", "dependsOn", "overrides", "methodImplements")
RISK_LEVELS = ("low", "medium", "high", "critical")

# File extension to language.
LANGUAGE_OF_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".php": "php", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".swift": "swift",
}
MAX_FILE_BYTES = 512 * 1024

# Ignored directories, extensions and files.
IGNORED_DIRS = """.git .svn .hg .bzr .idea .vscode .vs .eclipse .settings node_modules bower_components jspm_packages
vendor venv .venv env __pycache__ .pytest_cache .mypy_cache site-packages .tox eggs .eggs lib64 parts sdist wheels
dist build out output bin obj target .next .nuxt .output .vercel .netlify .serverless _build .parcel-cache .turbo .svelte-kit
coverage .nyc_output htmlcov .coverage __tests__ __mocks__ .jest logs log tmp temp cache .cache .tmp .temp
.generated generated auto-generated .terraform .husky .github .circleci .gitlab fixtures snapshots __snapshots__""".split()
IGNORED_EXTENSIONS = """.png .jpg .jpeg .gif .svg .ico .webp .bmp .tiff .tif .psd .ai .sketch .fig .xd
.zip .tar .gz .rar .7z .bz2 .xz .tgz .exe .dll .so .dylib .a .lib .o .obj .class .jar .war .ear .pyc .pyo .pyd .beam .wasm .node
.pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp .mp4 .mp3 .wav .mov .avi .mkv .flv .wmv .ogg .webm .flac .aac .m4a
.woff .woff2 .ttf .eot .otf .db .sqlite .sqlite3 .mdb .accdb .min.js .min.css .bundle.js .chunk.js .map .lock
.pem .key .crt .cer .p12 .pfx .csv .tsv .parquet .avro .feather .npy .npz .pkl .pickle .h5 .hdf5 .bin .dat .data .raw .iso .img .dmg""".split()
IGNORED_FILES = """package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Cargo.lock go.sum
.gitignore .gitattributes .npmrc .yarnrc .editorconfig .prettierrc .prettierignore .eslintignore .dockerignore Thumbs.db .DS_Store
LICENSE LICENSE.md LICENSE.txt CHANGELOG.md CHANGELOG CONTRIBUTING.md CODE_OF_CONDUCT.md SECURITY.md
.env .env.local .env.development .env.production .env.test .env.example""".split()

# Names of entry points (the first without regard to case) and of utilities (regular expressions).
ENTRY_POINT_NAMES = (
    "(?i)^(main|init|bootstrap|start|run|setup|configure)$",
    "^handle[A-Z]", "^on[A-Z]", "Handler$", "Controller$", "^process[A-Z]", "^execute[A-Z]", "^perform[A-Z]", "^dispatch[A-Z]",
    "^(index|show|store|update|destroy|create|edit)$", "^__invoke$", "^(get|post|put|delete|patch)[A-Z]",
)
UTILITY_NAMES = (
    "^(get|set|is|has|can|should|will|did)[A-Z]", "^_", "(?i)^(format|parse|validate|convert|transform)",
    "(?i)^(log|debug|error|warn|info)$", "^(to|from)[A-Z]", "Helper$", "Util(s)?$",
)
ENTRY_POINT_THRESHOLD, EXPORT_FACTOR, ENTRY_FACTOR, UTILITY_FACTOR = 1.0, 2.0, 1.5, 0.3
CORE_COMPONENT = "(?i)auth|payment|checkout|security|session|token"

# Stop words of keywords.
STOP_WORDS = "a an the and or of in to for is it on at by be as do if get set new this that with from".split()

# Layers and their patterns, without regard to case, by framework.
LAYERS = ("api", "controller", "service", "repository", "model")
LAYER_PATTERNS = {
    "generic": ("endpoint|route|controller.*action|api|@get|@post|@put|@delete", "controller|handler", "service|manager|business", "repository|dao|store", "model|entity|schema|table"),
    "nestjs": ("@get|@post|@put|@delete|@patch|endpoint", r"\.controller\.|controller|@controller", r"\.service\.|service|@injectable", r"\.repository\.|repository|typeorm", r"\.entity\.|entity|schema|@entity"),
    "spring": ("@requestmapping|@getmapping|@postmapping|@putmapping|@deletemapping", "@controller|@restcontroller|controller", "@service|service|serviceimpl", "@repository|repository|jparepository|crudrepository", "@entity|@table|entity|model"),
    "laravel": (r"route::|api\.php|web\.php", "controller|http/controllers", "service|action|manager", "repository|eloquent", "model|migration|schema"),
    "express": (r"router\.|\.route\(|\.get\(|\.post\(|\.put\(|\.delete\(", "controller|handler|routes/", "service|middleware|manager", "repository|dao|store", "model|schema|mongoose"),
    "django": (r"urls\.py|urlpatterns|path\(", r"views\.py|viewset|apiview", "service|manager|utils", r"repository|queryset|managers\.py", r"models\.py|model|django\.db"),
    "fastapi": (r"router|@app\.|endpoint|routers/", "controller|handler|endpoints/", "service|manager|business", "repository|crud|dao", "model|schema|sqlalchemy|pydantic"),
    "nextjs": (r"api/|route\.ts|route\.js|pages/api", r"handler|middleware|page\.tsx", "service|lib/|actions/", "repository|dao|prisma", "model|schema|entity"),
    "aspnet": (r"\[httpget\]|\[httppost\]|\[httpput\]|\[httpdelete\]|\[route\]", "controller|controllers/|apicontroller", "service|manager|business", "repository|dbcontext|entityframework", "model|entity|dto"),
}

# Framework by path, in order: (framework, parts of which one must be in the path, endings of which one must match).
FRAMEWORK_PATHS = (
    ("nestjs", ("/controllers/",), (".ts", ".js")),
    ("spring", ("/controller/", "/controllers/"), (".java",)),
    ("spring", (), ("controller.java", "controller.kt")),
    ("laravel", ("/http/controllers/",), (".php",)),
    ("laravel", (), ("controller.php",)),
    ("express", ("/routes/",), (".ts", ".js")),
    ("django", (), ("views.py", "urls.py")),
    ("fastapi", ("/routers/", "/endpoints/"), (".py",)),
    ("nextjs", ("/pages/",), ()),
    ("nextjs", ("/app/",), ("page.tsx",)),
    ("aspnet", ("/controllers/",), (".cs",)),
)

# Words that vote for a cluster's category, in order.
CATEGORY_WORDS = {
    "authentication": "auth login logout token jwt session password credential oauth permission role guard acl".split(),
    "dataAccess": "repository dao model entity schema migration query database db orm resource collection store persist record".split(),
    "businessLogic": "service manager handler processor calculator validator workflow rule policy engine orchestrat".split(),
    "uiComponent": "component view template render widget page layout form modal button input display".split(),
    "utility": "util helper format parse convert transform sanitize encode decode hash crypto logger config constant enum".split(),
}
GENERIC_FOLDERS = "src lib core utils common shared helpers".split()

# Patterns taken out of queries, in order.
MALICIOUS = (
    r"(?i)MATCH\s*\([^)]*\)", r"(?i)CREATE\s*\([^)]*\)", r"(?i)DELETE\s+\w+", r"(?i)DETACH\s+DELETE\s+\w+", r"(?i)MERGE\s*\([^)]*\)",
    r"(?i)SET\s+\w+\s*=[^;]*", r"(?i)REMOVE\s+\w+", r"(?i)DROP\s+\w+",
    r"(?i);\s*DROP\s+", r"(?i);\s*DELETE\s+FROM", r"(?i);\s*UPDATE\s+", r"(?i);\s*INSERT\s+INTO", r"(?i)UNION\s+SELECT", r"--[^\n]*", r"(?s)/\*.*?\*/",
    r"\$\([^)]*\)", r"`[^`]*`", r"\|\s*\w+", r"&&\s*\w+", r"\.\.[/\\]",
    r"(?is)<script[^>]*>.*?</script>", r"(?is)<iframe[^>]*>.*?</iframe>", r"(?i)javascript:", r"(?i)on\w+\s*=",
)
BAD_PATHS = (r"\.\.[/\\]", r"\.[/\\]\.", r"[/\\]\.\.[/\\]", r"(?m)^\.\.$", r"(?i)%2e%2e[/\\]", "(?i)%252e%252e", r"(?i)\.\.%2f", r"(?i)\.\.%5c", r"\x00", r'[<>"|?*]', r"^[/\\]", r"^[a-zA-Z]:[/\\]")
SOURCE_CODE = (
    r"function\s+\w+\s*\([^)]*\)\s*\{\s*\n[\s\S]{5,}", r"class\s+\w+\s*\{\s*\n[\s\S]{5,}", r"const\s+\w+\s*=\s*\([^)]*\)\s*=>\s*\{",
    r"if\s*\([^)]+\)\s*\{\s*\n[\s\S]{5,}", r"for\s*\([^)]+\)\s*\{\s*\n[\s\S]{5,}", r"while\s*\([^)]+\)\s*\{\s*\n[\s\S]{5,}",
    r"import\s+.*\s+from\s+['\"`]", r"require\s*\(['\"`][^'\"`]+['\"`]\)", r"\breturn\s+[^;]+;", r"\bthrow\s+new\s+\w+",
)
ABSOLUTE_PATH = r"(^|[\s:])([A-Z]:[/\\]|/[a-z]+/)"

# Intents of queries: (intent, pattern, confidence), in order; then the rest.
INTENTS = (
    ("preCommitCheck", r"\bpre.?commit\b|\bblast radius\b|\bchanged files?\b", 0.92),
    ("dataFlowTrace", r"\bdata.?flow\b|\btrace\b|\bapi.*database\b|\bendpoint.*model\b", 0.90),
    ("impactAnalysis", r"\bimpact\b|\bbreak\b|\bdepend\b|\baffect\b|\bchange\b", 0.88),
    ("contextRetrieval", r"\bcontext\b|\bcaller\b|\bcallee\b|\bwho calls\b|\bwhat calls\b", 0.85),
)
OTHER_INTENT = ("smartSearch", 0.75)

# Bounds and confidences.
MAX_DEPTH = 20
MAX_TRACE_DEPTH, MAX_BRANCHES = 20, 4
SIMILAR = 0.60
TIERS = {"same-file": 0.95, "named": 0.90, "import-scoped": 0.90, "package": 0.90, "global": 0.50}
PRESENT, ABSENT, UNCERTAIN = 0.95, 0.80, 0.50
DEPENDENT = 0.92

# Ecosystems, roots of Go modules, headers that are no packages.
ECOSYSTEMS = {"typescript": "npm", "javascript": "npm", "php": "composer", "python": "pip", "java": "maven", "rust": "cargo", "go": "go_modules"}
GO_HOSTS = "bitbucket.org codeberg.org git.sr.ht github.com gitlab.com golang.org".split()
SYSTEM_HEADERS = """algorithm array atomic bitset cassert cctype cerrno cfenv cfloat charconv chrono cinttypes climits clocale
cmath codecvt compare complex concepts condition_variable coroutine csetjmp csignal cstdarg cstddef cstdint cstdio cstdlib cstring ctgmath ctime cuchar cwchar
cwctype deque exception execution expected filesystem format forward_list fstream functional future initializer_list iomanip ios iosfwd iostream istream iterator latch
limits list locale map memory memory_resource mutex new numbers numeric optional ostream queue random ranges ratio regex scoped_allocator semaphore set
shared_mutex source_location span sstream stack stdexcept stdfloat stop_token streambuf string string_view strstream syncstream system_error thread tuple type_traits typeindex
typeinfo unordered_map unordered_set utility valarray variant vector version complex.h ctype.h errno.h fenv.h float.h inttypes.h iso646.h limits.h locale.h math.h
setjmp.h signal.h stdalign.h stdarg.h stdatomic.h stdbool.h stddef.h stdint.h stdio.h stdlib.h stdnoreturn.h string.h tgmath.h threads.h time.h uchar.h wchar.h wctype.h""".split()
