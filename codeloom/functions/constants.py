"""Fixed values that results depend on: kinds, languages, patterns, word lists."""

NODE_KINDS = "file class function method property field interface struct enum type_alias constant variable namespace module route trait protocol enum_member parameter import export component".split()
EDGE_KINDS = "contains calls imports extends implements references type_of returns instantiates overrides decorates exports".split()
CONTAINER_KINDS = "class interface struct trait protocol module enum".split()
SUPERTYPE_KINDS = "class struct interface trait protocol enum".split()
HIGH_VALUE_KINDS = "function method class interface type_alias struct trait component route variable constant enum module namespace".split()
CALLER_KINDS = ["calls", "references", "imports", "instantiates"]

KIND_BONUS = {
    "function": 10, "method": 10, "component": 9, "class": 8, "interface": 8, "struct": 8, "route": 7,
    "type_alias": 6, "enum": 6, "trait": 6, "protocol": 6, "constant": 5, "variable": 5, "property": 5, "field": 5,
    "namespace": 4, "module": 4,
}
OTHER_KIND_BONUS = 3

LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "go": "go", "rs": "rust", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "h": "c", "hpp": "cpp", "hxx": "cpp", "h++": "cpp", "c": "c",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "scala": "scala", "sc": "scala",
    "lua": "lua", "luau": "luau", "m": "objc", "r": "r", "R": "r", "yaml": "yaml", "yml": "yaml", "xml": "xml", "properties": "properties",
    "html": "html", "htm": "html", "css": "css", "sql": "sql", "json": "json", "md": "markdown", "sh": "shell", "bash": "shell", "zsh": "shell",
    "toml": "toml", "ini": "ini", "svelte": "svelte", "vue": "vue", "astro": "astro", "liquid": "liquid", "pas": "pascal", "pp": "pascal", "twig": "twig",
    "razor": "razor", "cshtml": "razor", "cfm": "cfml", "cfc": "cfml", "dfm": "pascal", "sol": "solidity", "ex": "elixir", "exs": "elixir", "ml": "ocaml", "res": "rescript", "zig": "zig",
}
LANGUAGE_FAMILY = {
    "typescript": "web", "javascript": "web", "tsx": "web", "jsx": "web", "arkts": "web", "python": "python", "go": "go", "rust": "rust",
    "java": "jvm", "kotlin": "jvm", "scala": "jvm", "c": "c", "cpp": "c", "csharp": "dotnet", "razor": "dotnet", "php": "php", "ruby": "ruby",
    "swift": "apple", "objc": "apple", "dart": "dart",
}
GENERATED_FILE = (
    r"\.pb\.go$|\.pulsar\.go$|_grpc\.pb\.go$|_mock\.go$|_mocks\.go$|^mock_[^/]+\.go$|\.generated\.[jt]sx?$|\.gen\.[jt]sx?$|\.pb\.[jt]s$|_pb\.[jt]s$|_grpc_pb\.[jt]s$|\.min\.m?js$"
    r"|_pb2(_grpc)?\.py$|_pb2\.pyi$|\.pb\.(cc|h)$|\.g\.cs$|Grpc\.cs$|OuterClass\.java$|Grpc\.java$|\.pb\.swift$|\.g\.dart$|\.freezed\.dart$|\.pb\.dart$|\.pbgrpc\.dart$|\.chopper\.dart$|\.generated\.rs$"
)
LOW_VALUE_PATH = r"(?:^|/)(tests?|__tests?__|spec)/|_test\.go$|(?:^|/)test_[^/]+\.py$|_test\.py$|_spec\.rb$|_test\.rb$|\.(test|spec)\.[jt]sx?$|(test|spec|tests)\.(java|kt|scala)$|(tests?|spec)\.cs$|tests?\.swift$|_test\.dart$"
TEST_PATH = (
    r"(?:^|/)(?:test|spec|tests?)\.|\.(?:test|spec)\.[jt]sx?$|_test\.(?:go|py|rb|dart)$|_spec\.rb$|(?:test|spec|tests?)\.(?:java|kt|scala|cs)$|tests?\.(?:swift)$|test_[^/]+\.(?:py|go)$"
    r"|(?:^|/)(?:tests?|__tests?__|spec|specs|test|testing)/|(?:^|/)(?:\.github|\.gitlab|\.circleci|\.travis|\.ci)/"
)
IGNORED_DIRS = """
.git node_modules bower_components jspm_packages web_modules .yarn .pnpm-store
.next .nuxt .svelte-kit .turbo .vite .parcel-cache .angular .docusaurus storybook-static .vinxi .nitro out-tsc .vercel .netlify .wrangler
dist build out .output coverage .nyc_output
__pycache__ __pypackages__ .venv venv .pixi .pdm-build .mypy_cache .pytest_cache .ruff_cache .tox .nox .hypothesis .ipynb_checkpoints .eggs
target .gradle obj vendor .build Pods Carthage DerivedData .swiftpm .dart_tool .pub-cache .cxx .externalNativeBuild vcpkg_installed .bloop .metals lua_modules .luarocks __history __recovery .cache
""".split()
#: Extension (lower case) to the name for display.
DISPLAY_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hh": "cpp",
    "cs": "csharp", "swift": "swift", "php": "php", "lua": "lua", "dart": "dart", "scala": "scala", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less",
    "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sh": "bash", "bash": "bash", "zsh": "zsh", "ps1": "powershell", "psm1": "powershell",
    "sql": "sql", "xml": "xml", "svg": "xml", "tf": "hcl", "tfvars": "hcl",
}

PROSE_STOP_WORDS = """
about above actually after again against almost along also always another anything around away back because been before behind being
below best better between both cannot come could does doing done down each either else even ever every everything fine first from
getting give goes going gone good great have having help here inside instead into just keep know last least less like likely
little look looking made make making many maybe mind more most much must need needs never next nice none nothing okay only
onto other otherwise over please pretty probably quite rather really right same seem seems should show since some someone something
somewhere soon still such sure take than thank thanks that their them then there these they thing things think this those though
tried tries trying under until upon very want wants well went were what when which while will wish with within without would
wrong your yours change changes check class classes code detail details directory error errors example examples file files folder function
functions issue issues line lines method methods name names problem problems project question questions rename test tests type types
update value values warning warnings work working write writing
""".split()

BUILT_INS = {
    "web": """console window document Promise Array Object String Number Boolean Map Set WeakMap WeakSet Date Math JSON RegExp Error TypeError SyntaxError
        ReferenceError RangeError parseInt parseFloat setTimeout setInterval clearTimeout clearInterval useState useEffect useContext useReducer useMemo
        useCallback useRef useImperativeHandle useLayoutEffect useDebugValue""".split(),
    "python": """print len range list dict set tuple str int float bool type isinstance issubclass hasattr getattr setattr delattr super property staticmethod
        classmethod enumerate zip map filter sorted reversed any all min max sum abs round open input repr id hash callable dir vars locals globals bytes NoneType
        append extend insert remove pop clear index count sort reverse copy keys values items get setdefault update popitem fromkeys add discard difference union
        intersection symmetric_difference startswith endswith find rfind rindex replace split rsplit join strip lstrip rstrip lower upper capitalize title swapcase
        encode decode format center ljust rjust zfill translate maketrans isalnum isalpha isdigit islower isupper isspace istitle isnumeric isdecimal isidentifier
        isascii casefold expandtabs partition rpartition splitlines""".split(),
    "go": """make new len cap append copy delete close panic recover print println error string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64
        float32 float64 complex64 complex128 bool byte rune uintptr complex real imag iota true false nil fmt os io net http context sync time strings strconv
        sort math errors log path bytes bufio regexp reflect unsafe runtime crypto hash unicode image mime testing plugin""".split(),
}
