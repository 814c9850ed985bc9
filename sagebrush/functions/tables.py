"""Word lists, lookup tables and patterns whose contents decide results."""

# Extension -> language.
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".php": "php", ".rb": "ruby",
    ".swift": "swift", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".sh": "bash", ".bash": "bash", ".css": "css",
    ".scss": "css", ".sass": "css", ".sql": "sql", ".r": "r", ".scala": "scala", ".lua": "lua", ".dart": "dart",
}

# Framework and what a lower-case path contains of it, in order.
FRAMEWORKS = [
    ("express", ["express", "expressjs"]), ("nextjs", ["nextjs", "next.js", "next-js"]), ("react", ["react", "reactjs", "react-js"]),
    ("vue", ["vue", "vuejs", "vue.js", "nuxt"]), ("angular", ["angular", "angularjs"]), ("svelte", ["svelte", "sveltekit"]),
    ("django", ["django"]), ("flask", ["flask"]), ("fastapi", ["fastapi", "fast-api"]), ("spring", ["spring", "springboot", "spring-boot"]),
    ("laravel", ["laravel"]), ("symfony", ["symfony"]), ("rails", ["rails", "ruby-on-rails", "ror"]), ("sinatra", ["sinatra"]),
    ("gin", ["gin", "gin-gonic"]), ("echo", ["echo"]), ("fiber", ["fiber"]), ("actix", ["actix", "actix-web"]), ("tokio", ["tokio"]),
    ("nestjs", ["nestjs", "nest.js"]), ("koa", ["koa"]), ("hapi", ["hapi"]), ("fastify", ["fastify"]),
    ("dotnet", ["dotnet", ".net", "asp.net", "aspnet"]), ("blazor", ["blazor"]), ("playwright", ["playwright"]), ("pytest", ["pytest"]),
    ("jest", ["jest"]), ("tailwind", ["tailwind"]), ("bootstrap", ["bootstrap"]), ("prisma", ["prisma"]), ("sequelize", ["sequelize"]),
]

# Words that are no keywords.
STOP_WORDS = """the a an is are was were be been being have has had do does did will would shall should may might must can could and but or nor
for yet so in on at to of by with from as into through during before after above below between out off over under again further then once here
there when where why how all each every both few more most other some such no not only own same than too very just because if that this these
those it its he she we they them their our which what who whom i me my you your him his her us""".split()

# Collection and what a lower-case path contains of it, in order.
ROUTES = [
    ("nodejs", ["express", "node", "npm", "next.js", "nextjs", "react", "vue", "angular", "svelte", "nuxt"]),
    ("python", ["django", "flask", "fastapi", "python", "pip", "pytest", "pydantic"]),
    ("go", ["go", "golang", "gin", "echo", "fiber"]),
    ("rust", ["rust", "cargo", "tokio", "actix"]),
    ("java", ["java", "spring", "maven", "gradle", "kotlin", "android"]),
    ("csharp", ["csharp", "c#", "dotnet", ".net", "asp.net", "blazor"]),
    ("php", ["php", "laravel", "symfony", "wordpress", "composer"]),
    ("ruby", ["ruby", "rails", "sinatra", "gems"]),
    ("swift", ["swift", "swiftui", "ios", "xcode"]),
    ("css_html", ["tailwind", "css", "html", "sass", "bootstrap"]),
    ("devops", ["docker", "kubernetes", "k8s", "ci/cd", "github-actions", "jenkins", "terraform"]),
    ("databases", ["sql", "postgres", "mysql", "mongodb", "redis", "prisma", "sequelize", "database"]),
]
# Language -> collection.
LANGUAGE_ROUTES = {"javascript": "nodejs", "typescript": "nodejs", "python": "python", "go": "go", "rust": "rust", "java": "java", "kotlin": "java", "csharp": "csharp", "php": "php", "ruby": "ruby", "swift": "swift", "css": "css_html"}
# The collections there are by default.
COLLECTIONS = ["fix_recipes", "nodejs", "python", "go", "rust", "java", "csharp", "php", "ruby", "swift", "css_html", "devops", "databases", "general", "personal"]
# The collections of content, in the order in which they are searched.
CONTENT = ["python", "nodejs", "go", "rust", "java", "csharp", "php", "ruby", "swift", "css_html", "devops", "databases", "general", "personal"]
# Extension -> language of files that count as code.
CODE_FILES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".swift": "swift", ".cpp": "cpp",
    ".c": "c", ".h": "c", ".css": "css", ".html": "html", ".sh": "bash",
}

# Technology and what a lower-case query contains of it, in order.
TECH = [
    ("nodejs", ["express", "node", "nodejs", "npm", "require(", "require('"]),
    ("python", ["django", "flask", "fastapi", "python", "pip", "pytest", "pandas", "numpy"]),
    ("react", ["react", "usestate", "useeffect", "jsx", "tsx", "next.js", "nextjs", "vite"]),
    ("typescript", ["typescript", "interface ", "type ", ": string", ": number", ": boolean", ".ts", ".tsx"]),
    ("rust", ["rust", "cargo", "crate", "fn main", "impl ", "trait ", "lifetime", "let mut"]),
    ("go", ["golang", " go ", "goroutine", "channel", "func main", 'import "fmt"']),
    ("java", ["java", "spring", "maven", "gradle", "public class", "public static void"]),
    ("devops", ["docker", "dockerfile", "compose", "kubernetes", "k8s", "helm"]),
    ("database", ["sql", "mysql", "postgres", "postgresql", "sqlite", "mongodb", "prisma", "sequelize"]),
]
# Label of a detected technology -> collection, in order.
TECH_LABELS = {
    "node.js": "nodejs", "nodejs": "nodejs", "node": "nodejs", "javascript": "nodejs", "js": "nodejs", "python": "python", "py": "python",
    "react": "react", "typescript": "typescript", "ts": "typescript", "rust": "rust", "go": "go", "golang": "go", "java": "java",
    "docker": "devops", "kubernetes": "devops", "k8s": "devops", "sql": "database", "mysql": "database", "postgres": "database",
    "postgresql": "database", "mongodb": "database",
}

_NOUN = r"(?:chapter|ch\.?|section|sec\.?|part|appendix|unit|module|lesson|topic)"
# The patterns of each class of queries, first class first.
QUERY_CLASSES = [
    ("scope", [
        rf"(?i)\b(?:explain|summarize|summarise|describe|cover|show|give me|tell me about|read|walk me through|go through|show me|summary\s+(?:for|of))\s+(?:the\s+)?(?:whole\s+|entire\s+|full\s+)?{_NOUN}\s+.{{1,60}}",
        rf"(?i)\b{_NOUN}\s+[\w.]+\s+(?:summary|content|details?|overview|explanation|notes?)",
        r"(?i)\bwhat(?:'s| is| does)?\s+(?:in\s+)?(?:the\s+)?(?:chapter|section|part|appendix|unit|module|lesson)\s+.{1,40}",
        r"(?i)\b(?:whole|complete|entire|full|all\s+of)\s+(?:the\s+)?(?:chapter|section|part|appendix|unit|module|lesson|topic)\s*.{0,40}",
        r"(?i)\b(?:explain|summarize|summarise|describe|show|tell me about|walk me through)\s+(?:the\s+).{3,40}?\s+(?:chapter|section|part|appendix|unit|module|lesson)\b",
        r"(?i)\b(?:explain|summarize|describe|show|give me|tell me about)\s+(?:chapter|section|part)\s+[\w.]+\s+(?:from|in|of)\s+.{3,60}",
        r"(?i)\b(?:chapter|section|part|appendix)\s*(\d[\d.]*)",
        r"(?i)\b(?:part|appendix)\s+([IVXLCDM]+|[A-Za-z])\b",
        r"^\s*(\d+\.\d+(?:\.\d+)?)\s+",
    ]),
    ("code_examples", [
        r"(?i)\b(?:show|give|list|find)\s+(?:me\s+)?(?:all\s+)?code\s+(?:examples?|samples?|snippets?)",
        r"(?i)\bcode\s+(?:examples?|samples?)\s+(?:for|about|related|on)\b",
        r"(?i)\ball\s+(?:examples?|code)\s+(?:about|for|related|on)\b",
        r"(?i)\b(?:examples?|snippets?)\s+(?:of|for|about)\s+.+\s+(?:from\s+all|across|in\s+every)\b",
    ]),
    ("error", [
        r"(?i)\b(error|typeerror|modulenotfounderror|importerror|attributeerror|nameerror|keyerror|valueerror|filenotfounderror|oserror|permissionerror)\b",
        r"\b(ENOENT|EACCES|ECONNREFUSED)\b",
        r"(?i)cannot\s+(find|read)",
        r"(?i)\b(undefined|null|fail(ed|ure)?|crash(ed|es)?|500|exception|traceback|panic|syntaxerror|referenceerror|unhandled|stack\s+trace)\b",
        r"(?i)no\s+module\s+named|not\s+installed",
    ]),
    ("structural", [
        r"(?i)\bhow\s+many\s+chapters?\b", r"(?i)\btable\s+of\s+contents\b", r"(?i)\bwhat.*chapter\s+\d",
        r"(?i)\bchapter\s+\d+\s+(?:subject|topic|cover|about|content)", r"(?i)\bsubject\s+of\s+chapter",
        r"(?i)\bwhat\s+(?:topics?|sections?)\s+(?:does|do|are|is)", r"(?i)\blist\s+(?:all\s+)?(?:chapters?|sections?|topics?)",
        r"(?i)\bwhat(?:'s| is)\s+(?:in|covered|included)\s+(?:in\s+)?(?:this\s+)?(?:book|document|pdf)",
        r"(?i)\boverview\s+of\s+(?:the\s+)?(?:book|document)", r"(?i)\bstructure\s+of\b", r"(?i)\boutline\b",
    ]),
    ("conceptual", [r"(?i)\b(how\s+to|explain|what\s+is|why\s+does|difference\s+between|when\s+should|what\s+are|how\s+does|concept|understand|meaning\s+of)\b"]),
    ("api", [r"(?i)\b(import|require|syntax|api|method|function|class|interface|returns|parameters?|arguments?|signature|overload)\b"]),
]
# The title of a book at the end of a query.
BOOK_HINT = r"""(?i)\b(?:from|in|of)\s+["']?(.{3,60})["']?\s*$"""

# Document types by the first characters of a text, in order.
DOC_TYPES = [
    ("tutorial", r"(?i)tutorial|getting started|how to|step by step|walkthrough"),
    ("api", r"(?i)\bAPI\b|reference|method\b|returns\b|parameters|endpoint"),
    ("guide", r"(?i)guide|overview|introduction|concepts"),
]
# Heading classification.
CLI_WORDS = "pip conda npm yarn git python node cargo go mvn gradle docker kubectl brew apt yum curl wget chmod mkdir cd ls cat echo export source".split()
CODE_WORDS = "if for while def class return import from print True False None var let const function async await new this try except catch throw yield lambda".split()
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
SHORT_WORDS = "an am as at be by do go he if in is it me my no of oh ok on or so to up us we".split()
# Context budgets (most tokens of the tier, system, anchor, reinforcement, memory, and the four thresholds).
BUDGETS = [
    ("small", 16384, 400, 300, 200, 500, 0.35, 0.50, 0.70, 0.90),
    ("medium", 65536, 500, 500, 300, 1000, 0.40, 0.60, 0.80, 0.95),
    ("large", None, 600, 800, 400, 1500, 0.50, 0.70, 0.85, 0.95),
]
# Strategies of the first two tiers of fixes.
TIER1 = "add_import remove_import update_import_path add_semicolon fix_indentation remove_duplicate apply_compiler_hint".split()
TIER2 = "fix_syntax update_type_annotation add_null_check cast_type initialize_variable add_missing_return close_bracket".split()
# Compiler hints (pattern, type, applicability), first match wins.
_DYM, _MAYBE, _SURE = "did_you_mean", "MaybeIncorrect", "MachineApplicable"
HINTS = [
    (r"help:[^\n]*similar name[\s\S]{0,300}?\d+\s*\|\s+([A-Za-z_]\w*)", _DYM, _MAYBE),
    (r"help:\s+.*similar name exists:\s*[`']([^`']+)[`']", _DYM, _MAYBE),
    (r"help:\s+consider (?:importing|using)[^:]*:\s*[`']?([^`'\n]+)[`']?", "suggested_import", _MAYBE),
    (r'"([^"]+)" imported and not used', "unused_import", _SURE),
    (r"(\w+) declared (?:and|but) not used", "unused_variable", _SURE),
    (r"did you mean(?:\s+one of)?:?\s*\n\s*\*\s*(\w+)", _DYM, _MAYBE),
    (r"""[Dd]id you mean to (?:use|call)\s+['`"]([^'`"]+)['`"]\??""", _DYM, _SURE),
    (r"""[Dd]id you mean:\s*['`"]?([^'`"?\n]+)['`"]?\??""", _DYM, _SURE),
    (r"""perhaps you meant\s+['`"]([^'`"]+)['`"]""", _DYM, _MAYBE),
    (r"""Are you missing.*?['`"]([^'`"]+)['`"]""", "missing_reference", _MAYBE),
    (r"""(?i)cannot find symbol[\s\S]{0,300}?did you mean\s*['`"]?(\w+)['`"]?\??""", _DYM, _MAYBE),
    (r"cannot access\s+(\w+)", "missing_reference", _MAYBE),
    (r"""(?i)Did you mean\s+\\?([^'`"\s?][^\s?]*)\s*\?""", _DYM, _MAYBE),
    (r"Undefined variable \$(\w+)", "undefined_variable", _MAYBE),
    (r"consider borrowing here:\s*[`']([^`']+)[`']", "borrow_suggestion", _MAYBE),
    (r"did you mean\s+'([^']+)'\?", _DYM, _SURE),
    (r"Unresolved reference:?\s*\w+.*?[Dd]id you mean\s+'?(\w+)'?\??", _DYM, _MAYBE),
    (r"""note:\s*suggested alternative:\s*['`"]([^'`"]+)['`"]""", _DYM, _MAYBE),
    (r"""note:\s*['`"]([^'`"]+)['`"]\s+declared here""", _DYM, _MAYBE),
    (r"Did you mean\?\s+(\S+)", _DYM, _MAYBE),
    (r"Try correcting the name to\s+'([^']+)'", _DYM, _MAYBE),
    (r"Try importing the library that defines\s+'([^']+)'", "suggested_import", _MAYBE),
    (r"""[Dd]id you mean[:\s]+['`"]([^'`"]+)['`"]\??""", _DYM, _SURE),
]

# Where definitions begin in source files, by language, and the lines that import (fixed values). A pattern stands at a
# line's start; blanks before it are those of its own line.
DEFINITIONS = {
    "javascript": [
        r"(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)",
        r"(?:export\s+)?class\s+(\w+)",
    ],
    "typescript": [
        r"(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[:=]",
        r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
        r"(?:export\s+)?interface\s+(\w+)",
    ],
    "python": [r"(?:async\s+)?def\s+(\w+)", r"class\s+(\w+)"],
    "go": [r"func\s+(?:\([^)]+\)\s+)?(\w+)", r"type\s+(\w+)\s+struct"],
    "rust": [r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"(?:pub\s+)?struct\s+(\w+)", r"(?:pub\s+)?enum\s+(\w+)", r"impl(?:<[^>]+>)?\s+(\w+)"],
    "java": [
        r"[ \t]*(?:public|private|protected)?\s*(?:static\s+)?(?:[\w<>\[\]]+)\s+(\w+)\s*\(",
        r"[ \t]*(?:public|private|protected)?\s*(?:abstract\s+)?class\s+(\w+)",
    ],
    "php": [r"[ \t]*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)", r"[ \t]*class\s+(\w+)"],
    "ruby": [r"[ \t]*def\s+(\w+)", r"[ \t]*class\s+(\w+)", r"[ \t]*module\s+(\w+)"],
}
CODE_LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".py": "python", ".go": "go",
    ".rs": "rust", ".java": "java", ".kt": "java", ".cs": "java", ".php": "php", ".rb": "ruby", ".swift": "java",
}
IMPORT_LINE = r"^(?:import|from|require|use|package|#include|using)\b|^(?:const|let|var)\s+\w+\s*=\s*require"
