"""Word lists and rules of the engine.

Lists that results depend on are fixed values, stated in full. Larger ones (a
gazetteer, words that are no names) are parameters of the operators that use
them; the defaults here are small and of this library's own choosing.
"""

from __future__ import annotations

# ---- fixed values: character entities that are decoded -------------------
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "\u2014", "ndash": "\u2013", "hellip": "\u2026",
    "rsquo": "\u2019", "lsquo": "\u2018", "rdquo": "\u201d", "ldquo": "\u201c", "deg": "\u00b0", "eacute": "\u00e9", "egrave": "\u00e8", "agrave": "\u00e0", "ccedil": "\u00e7",
}

# ---- fixed values: words that name a section ------------------------------
SECTION_WORDS = """
summary profile objective overview introduction background about experience
employment work history projects project skills technologies tools
education training certifications certification courses qualifications achievements
awards publications languages interests volunteer references contact portfolio
scope purpose definitions definition eligibility requirements requirement policy
policies procedure procedures fees fee payment payments refunds refund
cancellation termination liability warranty privacy security compliance
confidentiality governing jurisdiction severability amendments notices effective
term terms conditions responsibilities penalties disclaimer agreement parties
schedule appendix exhibit annex glossary index notes faq enquiries
""".split()

# ---- fixed values: words of a question that carry no subject --------------
SUBJECT_STOP_WORDS = """
the a an and or but if then than that this these those there their they them
is are was were be been being am do does did doing have has had having
i me my mine we us our ours you your yours he him his she her hers it
its who whom whose what which when where why how all any both each few more
most other some such no nor not only own same so too very can will just don
should now about into over after before between during under again further once
here from up down out off on in at to of for with by as also
many much often long short tell say says said write written mention
mentioned document note notes entry entries ask question answer compare
compared worse better best worst first last start end give show name names
like want need know think going thing things time times people person place
places day days year years month months week weeks weather anything
""".split()

# ---- fixed values: words of a question that say nothing about a gap -------
GAP_SCAFFOLD = """
what when where which who whom whose why how did does
doesnt dont done was were are is will would should could
can about there their them they this that these those
have has had any all some more most much many tell
says said say mention mentions mentioned name named names
give gives list lists happen happened happens time long
often again still just only very know think thing things
with from into over under than then and the for not
you your its his her him she like now yet also
""".split()

# ---- fixed values: function words a lexical query drops -------------------
QUERY_STOP_WORDS = """
a about after all also am an and any are as at
be because been before being between both but by
can could did do does doing done down during
each few for from further
had has have having he her here hers him his how
i if in into is it its
just me more most much must my
no nor not now of off on once only or other our out over own
same she should so some such
than that the their them then there these they this those through to too
under until up
very was we were what when where which while who whom why will with would
you your
""".split()

# ---- fixed values: capitalised words that are never a misspelling ---------
CALENDAR_WORDS = """
monday tuesday wednesday thursday friday saturday sunday
january february march april may june july august september october november december
""".split()
NEVER_MISSPELT = CALENDAR_WORDS + """
a an the and but so or if as at by for from in
into of on to with not no all any was were is are
be been have has had do does did will would can could
should might must it its i we our he she they
his her their this that these those there then when after
before during my me us them you your
""".split()

# ---- fixed values: words that open a sentence and are no first name -------
OPENERS = CALENDAR_WORDS + """
the this that these those there then they them their when where what which while
with without would could should after before during because however although though
every everything everyone nothing something someone anything another other first second
third last next today tomorrow yesterday dear note notes summary introduction conclusion chapter part section
she he it we you i my our his her its and but for not all some
one two three four five six seven eight nine ten new old good bad best worst
image figure table photo picture source references appendix total average report page
""".split()

MONTHS = "January February March April May June July August September October November December".split()

# ---- parameters with small defaults of our own ----------------------------
#: Places a document may name; pass a larger table to the operators for real use.
PLACES = """
Argentina|Australia|Austria|Belgium|Brazil|Canada|Chile|China|Denmark|Egypt|England|Finland|France|Germany|Greece|India|Ireland|Italy|Japan|Kenya|Mexico
Netherlands|New Zealand|Nigeria|Norway|Peru|Poland|Portugal|Scotland|South Africa|Spain|Sweden|Switzerland|Turkey|Ukraine|United Kingdom|United States|Wales
British Columbia|California|New York|Nova Scotia|Ontario|Quebec|Texas|Amsterdam|Athens|Auckland|Berlin|Boston|Calgary|Chicago|Dublin|Edinburgh|Geneva|Glasgow|Grimsby
Halifax|Hamilton|Lagos|Leeds|Lima|Lisbon|London|Madrid|Manchester|Melbourne|Montreal|Moscow|Mumbai|Nairobi|Oslo|Ottawa|Paris|Port Dover|Prague|Rome|Santiago|Seattle|Seoul|Stockholm
Sydney|Tokyo|Toronto|Vancouver|Vienna|Warsaw|Windsor|Zurich
""".replace("\n", "|").strip("|").split("|")
#: Words whose presence rules a capitalised phrase out as a name.
NOT_NAME_WORDS = CALENDAR_WORDS + """
engineer developer manager director officer consultant architect analyst designer administrator teacher nurse professor student
university college school institute academy hospital clinic bank company corporation inc ltd llc group partners department team
bachelor master diploma certificate degree science engineering technology studies
street road avenue drive lane boulevard court way highway park square bridge centre center station airport
python java javascript docker linux windows sql cloud server service system platform software hardware api
national international federal north south east west central america europe asia africa kingdom states republic
senior junior lead staff principal chief head built created worked led managed developed designed used
""".split()

#: (pattern of the question, terms to search for as well); fixed values.
INTENTS: list[tuple[str, list[str]]] = [
    (r"school|schooling|study|studies|studied|educat\w*|degree|diploma|graduat\w*|alma mater|university|college", ["education", "college", "university", "school", "degree", "diploma", "studies"]),
    (r"now|current\w*|present\w*|today|these days|at the moment|still", ["present", "current", "ongoing", "date"]),
    (r"job|jobs|employ\w*|work\w*|career|position|role", ["experience", "employment", "career", "consultant", "developer", "manager", "engineer"]),
    (r"live[sd]?|living|reside[sd]?|residence|home|address|located|location|based|move[sd]?", ["address", "residence", "living", "based", "located", "city"]),
    (r"born|birth\w*|birthday|age", ["born", "birth", "date of birth"]),
    (r"marri\w*|spouse|husband|wife|partner|separat\w*|divorc\w*", ["married", "marriage", "spouse", "husband", "wife", "separated", "separation", "divorce"]),
    (r"paid|pay|cost\w*|price|amount|salary|wage|fee|bill|spent|spend", ["paid", "cost", "price", "fee", "total", "deposit", "balance"]),
    (r"contact\w*|reach|email|phone|telephone|call", ["email", "phone", "telephone", "mobile", "address"]),
]

#: Questions offered for each kind of document, and whether one asks for the whole of it; fixed values.
QUESTIONS: list[tuple[str, str, bool]] = [
    ("resume", "What skills are listed?", True), ("resume", "Where has this person worked?", True), ("resume", "What did they do in the most recent role?", False),
    ("resume", "What education is listed?", True), ("resume", "Which employers and job titles are named?", True),
    ("job", "What are the essential qualifications?", True), ("job", "What are the responsibilities?", True), ("job", "What are the performance objectives?", True),
    ("job", "Which technologies and tools are named?", True), ("job", "What does it say about where and how the work is done?", False),
    ("news", "Who wrote it, and when was it published?", False), ("news", "What does it say happened?", False), ("news", "Who is quoted?", True),
    ("news", "Which places and organisations are named?", True), ("news", "What does it say happens next?", False),
    ("diary", "What is this document about?", False), ("diary", "What happened first, and what happened last?", False), ("diary", "Which month was busiest?", False),
    ("diary", "Who is mentioned most?", False), ("diary", "Where do the events take place?", True),
    ("policy", "What does it say about termination?", False), ("policy", "What notice is required?", False), ("policy", "What does each party have to do?", True),
    ("policy", "What does it say about payment?", False), ("policy", "What does it say about liability?", False),
    ("minutes", "What was decided?", True), ("minutes", "What action items are there?", True), ("minutes", "Who attended?", True),
    ("minutes", "What was discussed first?", False), ("minutes", "What was left unresolved?", True),
    ("transcript", "Who spoke, and about what?", True), ("transcript", "What was agreed?", True), ("transcript", "What questions were asked?", True), ("transcript", "What was said last?", False),
    ("statement", "What date range does it cover?", False), ("statement", "What amounts are listed?", True), ("statement", "Which payees or merchants are named?", True), ("statement", "What kinds of transactions appear?", True),
    ("long", "What is this document about?", False), ("long", "What themes does it return to?", False), ("long", "Who is mentioned most?", False),
    ("long", "What does it say at the beginning?", False), ("long", "What does it say near the end?", False),
]
KIND_LABELS = {
    "resume": "a resume", "job": "a job description", "news": "a news article", "diary": "a diary or a journal", "policy": "terms or an agreement", "minutes": "minutes of a meeting",
    "transcript": "a transcript", "statement": "a statement or a ledger", "long": "a long document — a book or a collection", "general": "a document",
}
QUESTIONS += [("general", q, w) for kind, q, w in QUESTIONS if kind == "diary"]
