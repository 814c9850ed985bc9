"""Test cases that the type of a parameter suggests, and stand-ins for modules, by language: fixed values."""

# Fixed values: (words of a type, (label, value)...), the first that the lower-case type contains; the last is for all others.
EDGES = {
    "typescript": [
        (["string"], ("empty", '""'), ("whitespace", '" "'), ("long", '"a".repeat(10000)')),
        (["number"], ("zero", "0"), ("negative", "-1"), ("NaN", "NaN"), ("Infinity", "Infinity")),
        (["boolean"], ("true", "true"), ("false", "false")),
        (["array", "[]"], ("empty", "[]"), ("single", "[1]"), ("with null", "[null]")),
        ([], ("undefined", "undefined"), ("null", "null")),
    ],
    "python": [
        (["str"], ("empty string", '""'), ("whitespace", '" \\t\\n"'), ("very long", '"a" * 10000'), ("unicode", '"\\u4f60\\u597d"'), ("null string", '"null"')),
        (["int", "float", "number"], ("zero", "0"), ("negative", "-1"), ("large", "2**63"), ("infinity", 'float("inf")'), ("NaN", 'float("nan")')),
        (["list", "array"], ("empty", "[]"), ("single", "[1]"), ("with None", "[None]")),
        (["dict", "map"], ("empty", "{}")),
        (["bool"], ("True", "True"), ("False", "False")),
        ([], ("None", "None")),
    ],
    "go": [
        (["*", "pointer"], ("nil", "nil"), ("valid pointer", "&value")),
        (["error"], ("nil error", "nil"), ("non-nil error", 'errors.New("fail")')),
        (["string"], ("empty", '""'), ("whitespace", '" "'), ("long", 'strings.Repeat("a", 10000)')),
        (["int", "float"], ("zero", "0"), ("negative", "-1"), ("max", "math.MaxInt64")),
        (["[]", "slice"], ("nil slice", "nil"), ("empty", "[]T{}"), ("single", "[]T{v}")),
        (["map"], ("nil map", "nil"), ("empty", "map[K]V{}")),
        (["bool"], ("true", "true"), ("false", "false")),
        ([], ("zero value", "zero value")),
    ],
    "rust": [
        (["option"], ("None", "None"), ("Some", "Some(value)")),
        (["result"], ("Ok", "Ok(value)"), ("Err", "Err(error)")),
        (["&str", "string"], ("empty", '""'), ("whitespace", '" "'), ("long", '"a".repeat(10000)')),
        (["i32", "i64", "int", "usize"], ("zero", "0"), ("negative", "-1"), ("max", "i32::MAX")),
        (["vec"], ("empty", "vec![]"), ("single", "vec![1]")),
        (["bool"], ("true", "true"), ("false", "false")),
        ([], ("default", "Default::default()")),
    ],
    "java": [
        (["optional"], ("empty", "Optional.empty()"), ("of", "Optional.of(value)"), ("ofNullable null", "Optional.ofNullable(null)")),
        (["string"], ("empty", '""'), ("null", "null"), ("whitespace", '" "'), ("long", '"a".repeat(10000)')),
        (["int", "long"], ("zero", "0"), ("negative", "-1"), ("MAX_VALUE", "Integer.MAX_VALUE"), ("MIN_VALUE", "Integer.MIN_VALUE")),
        (["list", "collection"], ("empty", "Collections.emptyList()"), ("null", "null"), ("single", "List.of(item)")),
        (["map"], ("empty", "Collections.emptyMap()"), ("null", "null")),
        (["boolean"], ("true", "true"), ("false", "false"), ("null Boolean", "null")),
        (["double", "float"], ("zero", "0.0"), ("NaN", "Double.NaN"), ("POSITIVE_INFINITY", "Double.POSITIVE_INFINITY")),
        ([], ("null", "null")),
    ],
}

# Fixed values: (pattern of a lower-case module name, kind, what its stand-in returns); the last is for all others.
MOCKS = {
    "typescript": [(r"prisma|sequelize|mongoose|knex|typeorm", "database", "[]"), (r"axios|fetch|got|node-fetch", "http", "{ status: 200, data: {} }"), (r"^fs$|^path$|^fs/promises", "filesystem", '"mock content"'), (r"nodemailer|sendgrid|resend", "email", '{ messageId: "mock" }'), (r"stripe", "payment", '{ id: "mock_id" }'), (r"", "generic", "jest.fn()")],
    "python": [(r"sqlalchemy|mongo|db|database|redis", "database", "[]"), (r"requests|httpx|aiohttp|urllib", "http", "Mock(status_code=200, json=lambda: {})"), (r"pathlib|shutil|tempfile", "filesystem", '"mock content"'), (r"smtp|email|sendgrid", "email", '{"message_id": "mock"}'), (r"", "generic", "Mock()")],
    "go": [(r"sql|gorm|ent|pgx", "database", "[]T{}, nil"), (r"http|gin|fiber|echo", "http", "&http.Response{StatusCode: 200}, nil"), (r"os|io|bufio", "filesystem", '"mock content", nil'), (r"", "generic", "nil")],
    "rust": [(r"sqlx|diesel|sea-orm|rusqlite", "database", "vec![]"), (r"reqwest|hyper|surf", "http", "Ok(Response::new())"), (r"tokio::fs|std::fs", "filesystem", '"mock content".to_string()'), (r"lettre|email", "email", "Ok(())"), (r"", "generic", "Default::default()")],
    "java": [(r"jpa|hibernate|jdbc|mybatis|r2dbc", "database", "new ArrayList<>()"), (r"webclient|resttemplate|okhttp|retrofit", "http", "ResponseEntity.ok(body)"), (r"java\.io|java\.nio|files", "filesystem", '"mock content"'), (r"javamail|sendgrid", "email", "void"), (r"", "generic", "Mockito.mock(Class.class)")],
}
