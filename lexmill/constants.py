"""Fixed values that results depend on, as plain text."""

# English stop words (those without an apostrophe, which a token cannot have).
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
shan shouldn wasn weren won wouldn
""".split())

# Programming words that are kept even where they are stop words.
PROGRAMMING_WORDS = frozenset("""
def return class import from if else elif for while in not and or is try except with as pass break continue lambda
yield global nonlocal del raise assert finally true false none function const let var async await this new typeof
instanceof extends export default null undefined then catch switch case api url http get set list dict map key value
index error type data id node item
""".split())

# Scoring.
K1, B = 1.5, 0.75
TITLE_FACTOR = 2.5
ACCEPTED_FACTOR = 1.3
OFFICIAL_FACTOR = 1.2
VOTE_WEIGHT = 0.1
TITLE_BONUS = 0.15
OVERFETCH = 3
ALPHA, BETA, GAMMA = 1.0, 0.75, 0.15
FEEDBACK_ROUNDS = 2
PSEUDO_RELEVANT = 3
POOL_DEPTH, EVAL_DEPTH = 10, 20
OFFICIAL_SOURCES = ("python_docs", "mdn")

# Snippets and page filters.
SNIPPET_LENGTH, WINDOW_LENGTH = 200, 150
THIN_PROSE, THIN_CODE = 100, 50

# Hosts whose pages are wanted, and what is unwanted there.
HOSTS = ("docs.python.org", "developer.mozilla.org")
MDN_UNWANTED = ("/en-US/search", "/en-US/plus", "/en-US/curriculum", "/en-US/blog", "/en-US/observatory", "/en-US/docs/Mozilla", "/en-US/docs/Tools")
PYTHON_UNWANTED = tuple("""
numeric filesys allos ipc internet markup mm crypto archiving binary datatypes functional text persistence fileformats
concurrency cmdlinelibs i18n netdata tk intro whatnow appendix debug development xml concurrent
""".split())
STATIC_FILES = ("pdf", "zip", "png", "jpg", "jpeg", "svg", "css", "js", "json", "xml", "ico", "woff", "woff2")

# Titles that contain one of these, in lower case, are junk.
JUNK_TITLES = (
    "copyright", "license", "about this documentation", "download python", "python 2", "what's new", "glossary",
    "genindex", "modindex", "search", "404", "page not found", "403", "forbidden", "python 3.5", "python 3.6",
    "python 3.7", "python 3.8", "frequently asked questions", "python howtos", "python faq", "deprecations",
    "whats new", "changelog", "python module index", "python documentation contents", "python/c api",
    "extending and embedding", "dealing with bugs", "networking and interprocess", "concurrent execution",
    "file and directory access", "data persistence", "data compression", "internet protocols", "structured markup",
    "numeric and mathematical", "functional programming", "generic operating system", "internet data handling",
    "graphical user interfaces", "text processing", "binary data services", "multimedia services",
    "internationalization", "cryptographic services", "command-line interface", "what now", "appendix",
    "interactive input", "debugging and profiling", "development tools", "audit events", "improve a documentation",
    "xml processing",
)

# The built-in query set.
DEFAULT_QUERIES = (
    "python list comprehension", "python data structures", "python file read write",
    "python error handling exceptions", "python classes and objects", "python functions arguments",
    "python string methods", "python dictionary operations", "python lambda map filter", "python generators iterators",
    "python decorators", "python modules import packages", "python sorting algorithms",
    "python regex regular expressions", "python json parsing", "async await javascript promise",
    "javascript dom manipulation", "javascript fetch api", "TypeError list index out of range",
    "AttributeError NoneType object",
)

# Pages from which a crawl starts.
START_URLS = (
    "https://docs.python.org/3/tutorial/index.html",
    "https://docs.python.org/3/library/index.html",
    "https://docs.python.org/3/reference/index.html",
    "https://docs.python.org/3/howto/index.html",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Guide",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference",
    "https://developer.mozilla.org/en-US/docs/Web/API",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Global_Objects",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Statements",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Operators",
    "https://developer.mozilla.org/en-US/docs/Web/HTML/Element",
    "https://developer.mozilla.org/en-US/docs/Web/CSS/Reference",
    "https://developer.mozilla.org/en-US/docs/Web/API/Fetch_API",
    "https://developer.mozilla.org/en-US/docs/Web/API/Document_Object_Model",
    "https://developer.mozilla.org/en-US/docs/Web/API/Window",
    "https://developer.mozilla.org/en-US/docs/Web/API/EventTarget",
    "https://developer.mozilla.org/en-US/docs/Web/API/Promise",
    "https://developer.mozilla.org/en-US/docs/Learn/JavaScript",
)
MOST_PAGES = 10000

# Terms looked up to try a new index.
SMOKE_TERMS = ("python", "list", "function", "error", "async")

EFFECTIVE_STOP_WORDS = STOP_WORDS - PROGRAMMING_WORDS
