"""Word lists. All are parameters of the functions that use them; these are the defaults."""

from __future__ import annotations

# Stop words of the index, the reranker, extraction and grounding differ on purpose.
BM25_STOP = """a an the and or but in on at to for of with by from into through during before after above below between over under is are was
were be been being am it its this that these those there here as if because while until than then once no nor only own same some any all both
each few more most other such very too can could would should will shall may might must just now what which who whom whose when where why how
do does did have has had please tell explain give show find know describe detail details information mean means meaning carry carries carried
transport transports transported contain contains produce produces provide provides include includes use uses का के की और में है हैं था थी थे से
पर को यह वह ये वे एक इस उस इन उन या तो भी ही क्या कौन कब कहाँ क्यों कैसे करता करती करते""".split()
RERANK_STOP = """a an the is are was were be been being am in on at to for with by about against between into through during before after
above below from up down of off over under again further then once here there all any both each few more most other some such no nor only own
same so than too very can will just should now what which who whom whose this that these those it its they them their theirs he him his she her
hers you your yours we our ours and or if because as until while does did do doing have has had having please tell explain give know find show
describe detail details information meaning means mean definition define function purpose reason way used use uses work works working क्या है हैं
था थी थे हो होता होती होते और या के का की को से में पर एक यह वह ये वे इस उस इन उन लिए कैसे क्यों कौन किस किसे किसका किसकी किसके करता करती करते करना करने
करें बताएं बताओ समझाएं समझाओ अर्थ मतलब परिभाषा कार्य उद्देश्य क्योंकि किसलिए""".split()
EXTRACT_STOP = """a an the is are was were be been being am in on at to for with by about against between into through during before after
above below from up down of off over under again further then once here there all any both each few more most other some such only own same so
than too very can will just should now what which who whom whose this that these those it its they them their theirs he him his she her hers
you your yours me my myself we our ours and or if because as until while does did do having have has please tell explain give know find show
describe detail details information like""".split()
GROUND_STOP = """a an the is are was were be been being am and or but if then than that this these those of to in on at for from with by as
it its they them their he his she her your you we our यह वह ये वे इस उस इन उन का की के को से में पर और या एक है हैं था थी थे हो ही भी""".split()
NEGATION = "not no never without neither nor नहीं नही न बिना कभी".split()
GENERIC_TERMS = ["body", "body part", "body parts", "part", "parts", "thing", "things", "person", "people", "information", "what", "why", "how", "when",
    "where", "who", "which", "capital", "system", "systems", "place", "places", "stuff", "item", "items", "data", "fact", "facts", "tell me", "give me",
    "describe", "details", "name", "names", "object", "objects", "something", "anything", "word", "words"]
AUTHORSHIP = """created create creator creates creating invent invented inventor invents inventing implement implemented implementation implements
implementing develop developed developer develops developing design designed designer designs designing found founded founder founds founding
establish established establishment build built builder author authored publish published propose proposed start started""".split()
COMPOUND_ENTITIES = ["tamil nadu", "uttar pradesh", "madhya pradesh", "himachal pradesh", "andhra pradesh",
    "arunachal pradesh", "west bengal", "jammu and kashmir", "vasco da gama", "vikram sarabhai", "indus valley", "arabian sea", "western ghats",
    "eastern ghats", "mariana trench", "sahara desert", "amazon river", "mount everest", "mohenjo daro", "operation vijay", "ऑपरेशन विजय"]
SINGLE_ENTITIES = """haryana goa isro delhi punjab karnataka maharashtra kerala gujarat rajasthan bihar bengal india hnsw bm25 rrf sarabhai
aryabhata python timsort mariana sahara amazon panaji vasco margao indus harappa mohenjo ajanta ellora everest chandigarh bengaluru mumbai kolkata
chennai hyderabad phloem xylem dna""".split()
RELATION_WORDS = """carry carries carried carrying transport transports transported transporting contain contains produce produces cause causes
use uses include includes provide provides make makes move moves store stores control controls लेता लेती लेते परिवहन स्थानांतरित उत्पन्न बनाता बनाती
बनाते रखता रखती रखते नियंत्रित करता करती करते""".split()
ACTION_WORDS = """carry carries carried transport transports transported move moves contain contains produce produces provide provides include
includes cause causes make makes mean means meaning function purpose work works working used use uses located location found founded established ले
जाता जाती जाते परिवहन करता करती करते अर्थ मतलब कार्य उद्देश्य""".split()
GENERIC_SUBJECTS = "mere pas main mujhe mera meri my me i we our hum hamare hamari hamara".split()
TRANSITIONS = ["furthermore", "moreover", "however", "in addition", "on the other hand", "consequently", "therefore", "as a result", "in conclusion",
    "firstly", "secondly", "specifically", "for example", "for instance", "meanwhile", "इसके अलावा", "हालांकि", "परिणामस्वरूप", "उदाहरण के लिए",
    "विशेष रूप से", "तथापि", "অন্যদিকে", "উদাহরণস্বরূপ", "மேலும்", "எனவே"]

# What each entity or event is also called, in the order in which expansion appends it.
ENTITY_ALIASES = {
    "goa": ["गोवा", "panaji", "पणजी", "margao", "vasco", "वास्को", "konkan", "कोंकण", "portuguese", "पुर्तगाली", "1961", "operation vijay", "ऑपरेशन विजय"],
    "गोवा": ["goa", "panaji", "पणजी", "vasco", "वास्को", "margao", "कोंकण", "konkan", "1961", "ऑपरेशन विजय", "operation vijay"],
    "panaji": ["पणजी", "goa", "गोवा", "capital", "राजधानी"],
    "पणजी": ["panaji", "goa", "गोवा", "राजधानी", "capital"],
    "isro": ["indian space research organisation", "indian space research organization", "भारतीय अंतरिक्ष अनुसंधान संगठन", "sarabhai", "vikram sarabhai", "विक्रम साराभाई", "bengaluru", "बेंगलुरु", "1969", "aryabhata", "आर्यभट"],
    "भारतीय अंतरिक्ष अनुसंधान संगठन": ["isro", "indian space research organisation", "indian space research organization", "साराभाई", "sarabhai", "बेंगलुरु", "1969"],
    "hnsw": ["hierarchical navigable small world", "approximate nearest neighbor", "ann", "malkov", "yashunin", "vector search"],
    "hierarchical navigable small world": ["hnsw", "approximate nearest neighbor", "malkov"],
    "bm25": ["okapi bm25", "okapi", "probabilistic relevance framework", "robertson", "sparck jones"],
    "okapi bm25": ["bm25", "okapi", "probabilistic relevance framework"],
    "rrf": ["reciprocal rank fusion", "cormack", "clarke", "buettcher", "hybrid search"],
    "reciprocal rank fusion": ["rrf"],
    "timsort": ["tim sort", "tim peters", "peters", "sorting algorithm", "python 2002"],
    "tim sort": ["timsort", "tim peters"],
    "tim peters": ["timsort", "python 2002"],
    "btree": ["b-tree", "b-trees", "btrees", "b tree", "bayer", "mccreight", "database indexing", "self-balancing"],
    "btrees": ["b-tree", "b-trees", "btree", "b tree", "database indexing"],
    "b-tree": ["btree", "btrees", "b-trees", "b tree", "database indexing"],
    "b-trees": ["btree", "btrees", "b-tree", "b tree", "database indexing"],
    "operation vijay": ["ऑपरेशन विजय", "1961", "liberation of goa", "liberated", "पुर्तगाली शासन", "मुक्त कराया", "गोवा", "goa"],
    "ऑपरेशन विजय": ["operation vijay", "1961", "गोवा", "goa", "पुर्तगाली", "मुक्त कराया"],
    "ajanta": ["ajanta caves", "अजंता", "अजंता गुफाएं", "aurangabad", "औरंगाबाद", "chhatrapati sambhaji nagar", "maharashtra"],
    "अजंता": ["ajanta", "ajanta caves", "औरंगाबाद", "aurangabad"],
    "phloem": ["फ्लोएम", "फ्लोएम ऊतक", "phloem tissue"],
    "फ्लोएम": ["phloem", "phloem tissue", "फ्लोएम ऊतक"],
    "xylem": ["जाइलम", "जाइलम ऊतक", "xylem tissue"],
    "जाइलम": ["xylem", "xylem tissue", "जाइलम ऊतक"],
    "godavari": ["गोदावरी", "dakshin ganga", "दक्षिण गंगा", "peninsular river", "nashik", "trimbakeshwar"],
    "गोदावरी": ["godavari", "dakshin ganga", "दक्षिण गंगा"],
    "western ghats": ["पश्चिमी घाट", "sahyadri", "सह्याद्री"],
    "पश्चिमी घाट": ["western ghats", "sahyadri"],
    "mariana trench": ["challenger deep", "mariana", "pacific ocean"],
    "amazon river": ["amazon", "south america", "atlantic ocean"],
    "sahara desert": ["sahara", "north africa"],
    "dna": ["double helix", "watson", "crick", "franklin", "1953", "nature"],
    "indian": ["india", "subcontinent"],
    "india": ["indian", "subcontinent"],
    "portuguese": ["portugal", "goa", "1961"],
    "brazilian": ["brazil", "amazon"],
}
EVENT_SYNONYMS = {
    "liberated": ["liberation", "liberate", "मुक्त कराया", "मुक्त", "1961", "operation vijay", "ऑपरेशन विजय"],
    "liberation": ["liberated", "liberate", "मुक्त कराया", "मुक्त", "1961", "operation vijay", "ऑपरेशन विजय"],
    "liberate": ["liberated", "liberation", "मुक्त कराया", "मुक्त", "1961"],
    "मुक्त": ["liberated", "liberation", "मुक्त कराया"],
    "rule": ["ruled", "ruler", "शासन", "पुर्तगाली"],
    "ruled": ["rule", "ruler", "शासन", "पुर्तगाली"],
    "landed": ["land", "arrival", "arrived", "voyage", "16th century"],
}
