"""Problem 9: template residue, filler, site messages and script notices instead of content.

Placeholders are found by one grammar for each kind of delimiter, whatever their length. A match is discounted where its
surroundings speak about it: inside a quotation that has words besides it; inside a code block (fenced, marked up, or
indented with a control statement or after a line announcing it); in a sentence that mentions unfilled fields or the syntax of
templates. Where more fields are discounted as syntax than are left, the text is a tutorial and all are.
Conventional elisions ([...], […]), page and note
numbers, redactions (XXXX) and illegible dates (??/??/1975) are no placeholders at all. The density given is the share of lines
that hold an open field.

Filler and messages are judged by density. A text is cut into lines and sentences; each unit is
page remains (menus, notices of rights, counters), filler, a message, or content. A unit is filler by the share of its words that
filler is made of, a message by the share of words that name parts of a site and what may be the matter with them, in
some twenty languages, whatever their order; phrases and status codes add to both. The text is
excluded where messages and filler make up at least half of what is not page remains, quoted
words not counting as a message. All patterns see the whole text.

Defined results: null, empty and blank texts are no case. Each row is judged alone, so repeated
texts get the same verdict.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .arrowmap import arrow_map

#: Share of messages and filler, in characters without page remains, from which a text is excluded.
DENSITY = 0.5

_NAME = r"[^\W\d]\w*"
#: Grammar by delimiter.
PLACEHOLDERS = {
    "double_brace": r"\{\{\s*+[^{}\n]++\s*+\}\}",
    "statement": r"\{[%#][^{}\n]+?[%#]\}",
    "dollar_brace": r"[$#@]\{\s*+[^{}\n]++\}",
    "brace_number": r"(?<![\w{\\])\{\d{1,2}\}(?!\})",
    "brace_name": rf"(?<![\w{{$#@\\])\{{{_NAME}(?:[ ._-]\w+)*\}}(?!\}})",
    "server_tag": r"(?:<|&lt;)[%?]=?\s*+[^<>\n]+?[%?](?:>|&gt;)",
    "include": r"(?:<|&lt;)!--\s*+#\s*+[^<>\n]+?--(?:>|&gt;)",
    "double_angle": r"(?:<<|&lt;&lt;)\s*+[^<>&\n]++(?:>>|&gt;&gt;)",
    "angle": r"(?<!<)<(?!/)[^\W\d_][\w.-]*(?: [\w.-]+){0,5}>(?!>)",
    "double_square": r"\[\[\s*+[^\[\]\n|]++\]\]",
    "square_caps": r"(?<!\[)\[(?=[^\[\]\n]*[^\W\d_]{2})(?:(?![^\W\d_])[^\[\]\n]|[A-ZΑ-ΩΆΈΉΊΌΎΏÇĞİÖŞÜА-ЯЁ]){3,}\](?!\])",
    "square_order": r"(?i:\[\s*(?:insert|enter|add|type|fill in|specify|συμπληρώστε|εισαγάγετε|εισάγετε|προσθέστε|gir|doldur|insérer|saisir|einfügen|eintragen|introduceți|completați|вставьте|укажите|введите|впишете|въведете)\b[^\[\]\n]*\])",
    "square_order_end": r"(?i:\[[^\[\]\n]+?\b(?:giriniz|girin|yazınız|doldurunuz|ekleyin|einfügen|eintragen|here|εδώ|to be (?:completed|confirmed|inserted)|tbc|tbd|να συμπληρωθεί|doldurulacak)\s*\])",
    "square_blank": r"\[\s*[●•■_□▪*]+\s*\]",
    "square_field": r"(?<!\[)\[(?i:party|name|court|date|amount|judge|docket|case|client|insert|όνομα|ημερομηνία|ποσό|δικαστήριο|διάδικος|πελάτ|isim|tarih|mahkeme|tutar|taraf)[^\[\]\n\d]*\](?!\])",
    "percent": rf"%(?=[^%\s]{{3,}}%)(?:[A-ZΑ-ΩΆΈΉΊΌΎΏÇĞİÖŞÜА-ЯЁ_]{{3,}})%",
    "dollar": rf"(?<![\w$])\${_NAME}\$",
    "hash": r"(?<![\w#])#[^\W\d][\w-]{2,}#",
    "guillemet": rf"«\s*{_NAME}_\w+\s*»",
    "underline": r"(?<!\w)__[^\W\d_]\w*?__(?!\w)",
    "model": r"(?<![\w.])@(?:Model|Html|ViewBag|item|this)\.\w+",
    "parenthesis": r"(?i:\([^()\n]*?\b(?:να συμπληρωθεί|προς συμπλήρωση|doldurulacak|to be (?:completed|filled in|inserted|confirmed|supplied)|tbc|tbd|fill in|à compléter|auszufüllen|de completat|заполнить)\s*\))",
    "masked_date": r"(?<![\w/])(?:XX|DD|ΗΗ|ΧΧ|GG)[/.-](?:XX|MM|ΜΜ|ΧΧ|AA)[/.-](?:(?:19|20)?(?:XX|ΧΧ)|YYYY|YY|ΕΕΕΕ|XXXX|YYY?Y?)(?!\w)",
    "question": rf"\?\?{_NAME}\?\?",
    "at_name": r"(?<![\w@.])@@[A-Za-z_]\w*@@",
    "tilde": r"(?<!\w)~~?[A-Z_]{3,}~~?(?!\w)",
    "pipe": r"(?<![\w|])\|\|?[A-Z_]{3,}\|\|?(?!\w)",
    "no_value": r"(?:(?<=€ )|(?<=[:,] )|(?<=[^\x00-\x7f] )|(?<=Dear )|(?<=Sayın )|(?<=[£$€]))(?:undefined|NaN|null|None|\[object Object\])(?=[.,;:]?(?:\s|$))",
    "object": r"\[object Object\]",
}
_PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PLACEHOLDERS.items()))
#: Where a grammar can begin; the grammars are tried only there.
_START = re.compile(r"[{<\[$%#@~|«]|&lt;|__|\?\?(?=\w)|(?:XX|DD|ΧΧ|ΗΗ|GG)(?=[/.-])|undefined|NaN|null|None|\((?=(?i:[^()\n]*?(?:συμπλ|doldurul|tb[cd]|to be|fill|compl|ausz|запол)))")
#: Substrings of lower-case text of which every message or filler has one; texts without any are content.
STEMS = (
    "error|not found|could not be|cannot be|does not|temporarily|expired|no longer|been moved|been removed|been deleted|denied|refused|restricted|permission|have access|authoris|authoriz|forbidden|session|sign in|log in|again|no result|spelling|fewer terms|your search|maintenance|system|too many|limited|limit|unable to|something|oops|unexpected|not respond|unavailable|is down|timed out|overloaded|gateway|bad request|refresh|contact the|return to|link you|incident|inconvenience|apolog|script|cookie|browser|human|robot|security check|captcha|seconds|please wait|reload|loading…|traceback|file \"|exception:|error:|warning:|notice:|stack trace|expects|on line|ora-|sqlstate|status|gone|error"
    "|έχετε|υπάρχει|πρόσβαση|συνεδρία σας|συνεδρία έ|συνδεθείτε|αποτελέσματα|ορθογραφ|λιγότερους|συντήρησ|συγγνώμη|βρέθηκε|μετακιν|έχει λήξει|προσωρινά|αντιστοιχεί|προβληθεί|φορτωθεί|σφάλμα|έγκυρο|απρόσμεν|δοκιμάστε|ανταποκρ|διαθέσιμ|αδυναμία|ανανεώστε|επικοινωνήστε|κωδικός|αιτήματα|περιορίστ|επιστρέψτε|στραβά|ενεργοποι|σενάρι|φορτώστε|ασφαλείας…|ασφαλείας.|έλεγχος ασφ|επαληθ|άνθρωπος|φυλλομετρ|περιήγησ|δευτερόλεπτ"
    "|bulunamadı|taşınmış|silinmiş|dolmuş|kilitli|karşılık gel|yüklenemedi|görüntülen|erişim|erişme|yetkiniz|izniniz|oturum|yeniden|tekrar|yazımı|daha az|bakım|sunucu|geçersiz|beklenmeyen|bir sorun|hizmet|yenileyin|başvurun|olay kodu|başvuru kodu|çok fazla|dizine|özür|betik|tarayıcı|güvenlik|insan ol|hata"
    "|не найден|доступ|сеанс|включите|техническ|сервер|introuvable|non trouvée|accès|expiré|activez|aucun|en maintenance|nicht gefunden|verweigert|abgelaufen|aktivieren|keine|wartung|fost găsită|interzis|refuzat|expirat|намерена|достъпът|未找到|不存在|被拒绝|请启用|过期|غير موجودة|رفض الوصول|انتهت"
    "|lorem|ipsum|dolor|amet|consectetur|adipisc|λορεμ|ίψουμ|δολόρ|αμέτ|στοιχειοθεσία|sample|dummy|placeholder|filler|test test|test. test|test, test|test text|test copy|test content|test para|example text|example copy|example content|example para|goes here|comes here|will go here|describe the|added|paragraph text|section title|heading here|title here|add text|add your|coming soon|δοκιμ|δείγμα|εδώ|τίτλος|προσθέστε|παραγράφου|προστεθεί|σύντομα|örnek|deneme|metin|buraya|içerik|bölüm|paragraf|пример|заполнитель|здесь|exemple|faux texte|votre texte|beispieltext|blindtext|einfügen|exemplu|за пример|示例|占位|تجريبي"
).split("|")


def _any_stem():
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile("|".join(map(re.escape, STEMS)))
        return lambda text: pattern.search(text) is not None
    automaton = ahocorasick.Automaton()
    for stem in STEMS:
        automaton.add_word(stem, True)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


_stem_in = _any_stem()


def _has_stem(text: str) -> bool:
    return _stem_in(text.replace("İ", "i").lower())

#: Words in square brackets that are editorial, not fields.
_EDITORIAL = re.compile(r"(?i)\[\s*(?:sic|emphasis.*|…|\.{2,}|[\d\s,.;:/–-]+|[ivxlc]+|\w)\s*\]")
_QUOTED = re.compile(r"«[^«»\n]*»|“[^“”\n]*”|„[^„“”\n]*[“”]|(?<![\w\"])\"[^\"\n]*\"|「[^」\n]*」|(?<![\w'])‘[^‘’\n]*’(?!\w)")
_CODE = re.compile(r"```.*?```|`[^`\n]+`|<code>.*?</code>|<pre>.*?</pre>", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…;;。！？])[\s\"'»”)]+|\n+")
#: A sentence that speaks of fields left open, as a finding does.
_MENTION = re.compile(r"(?i)\b(?:never (?:filled|completed)|left blank|standard form read|nobody ever filled|χωρίς (?:ποτέ )?να συμπληρωθεί|κενό πεδίο|ρήτρα του εντύπου|hiç doldurulma|boş bırakıl)")
#: A sentence that speaks of the syntax of fields, as a tutorial does.
_SYNTAX = re.compile(
    r"(?i)\b(?:placeholders?|template (?:syntax|language|engine|tag|variable|expression)s?|merge fields?|syntax|jinja|mustache|handlebars|liquid tags?|twig|f-?strings?|format strings?|curly brac\w+|double brac\w+|angle bracket\w*"
    r"|(?:you|we|one) (?:can |may |would |should )?(?:write|type|put)s?|(?:to|will|would) (?:print|output|render)|renders? (?:as|to|the)|prints? the|expands? to|evaluates? to|variable|loops? over|(?:is|are|gets?) (?:replaced|substituted) (?:by|with)"
    r"|σύνταξη|μεταβλητή|αγκύλες|άγκιστρα|γράφ(?:ουμε|ετε|εις)|αντικαθίσταται|söz ?dizimi|değişken|yazılır|küme parantez\w*|ile değiştirilir|syntaxe|variable|accolades|on écrit|est remplacé|schreibt man|geschweifte|platzhalter|wird ersetzt|sintaxis|se escribe|sintassi|si scrive|переменн\w+|синтаксис\w*|заменяется|синтаксис)\b"
)
_CONTROL = re.compile(r"\{%|\{\{[#/^]|<%(?!=)|\{#")
_INDENTED = re.compile(r"(?:^(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z)(?:[ \t]*\n)*+)+", re.M)

_FILLER = re.compile(
    r"(?i)\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|λορεμ|ίψουμ|δολόρ|αμέτ|στοιχειοθεσία)\b.*?\b(?:lorem|ipsum|dolor|sit|amet|velit|quidem|ergo|causa|λορεμ|ίψουμ|δολόρ|σιτ|αμέτ|γέμισμα|δοκιμή|τυχαία)\b"
    r"|\b(?:sample|dummy|placeholder|filler|test|example) (?:text|copy|content|paragraph)\b|\b(?:text|content|description) (?:goes|will go|comes) here\b|^\W*describe the \w+ here|\bcontent (?:will be|to be) added|\b(?:test\W+){2,}test\b|^\W*(?:paragraph text|section title|heading here|title here|add text|add your text(?: here)?)\W*$|\bplaceholder copy\b|\bcoming soon\b"
    r"|(?:κείμενο|δείγμα) (?:δοκιμής|κειμένου)|εδώ μπαίνει|^\W*(?:τίτλος ενότητας|προσθέστε κείμενο|κείμενο παραγράφου)\W*$|περιεχόμενο θα προστεθεί|περιγραφή \w+ εδώ|(?:δοκιμή\W+){2,}δοκιμή|σύντομα κοντά σας"
    r"|örnek metin|deneme metni|metin (?:buraya|ekleyin)|buraya (?:metin|gelecek|yazılacak)|metni buraya|içerik (?:daha sonra|sonra|yakında)|(?:dava|konu) açıklaması buraya|bölüm başlığı|(?:deneme\W+){2,}deneme|paragraf metni"
    r"|пример текста|текст[- ]заполнитель|здесь будет|texte d['’]exemple|faux texte|votre texte ici|beispieltext|blindtext|text hier einfügen|text de exemplu|текст за пример|示例文本|占位|نص تجريبي"
)
_FILLER_WORDS = set("lorem ipsum dolor sit amet velit quidem ergo causa tempus nostrum silva fabula ordine umbrae aliquot consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua λορεμ ίψουμ δολόρ σιτ αμέτ γέμισμα δοκιμή τυχαία στοιχειοθεσία κείμενο λέξεις παραδείγματος".split())

_MESSAGE = re.compile(
    r"(?i)\b(?:HTTP )?(?:error|status|σφάλμα|hata|erreur|fehler|eroare|ошибка|грешка)\b\W{0,3}(?:code\W*|HTTP\W*|κωδικός\W*|kodu\W*)?\(?[45]\d\d\b|\b[45]\d\d\b\W{0,4}(?:not found|forbidden|bad gateway|service unavailable|gateway time|internal|unauthorized|bad request|too many|page|error|η σελίδα|σελίδα|σφάλμα|sayfa|hata|access|denied|gone)"
    r"|\b(?:page|ruling|document|judgment|address|file|url|link|docket)\b[^.]{0,40}\b(?:not found|could not be (?:found|located|loaded|displayed)|does not (?:exist|match)|cannot be (?:found|displayed)|has been (?:moved|removed|deleted)|no longer (?:exists|available)|temporarily (?:locked|unavailable)|may have expired)"
    r"|\baccess (?:denied|refused|is restricted)|\b(?:do not|don['’]t) have (?:permission|access)|\bnot authori[sz]ed to|\bpermission denied\b|\bforbidden\b\W*$|\bsession (?:has |is )?(?:expired|timed out)|\b(?:sign|log) in again\b|\bplease (?:sign|log) in\b|\b(?:try|retry) again (?:later|in)|\bno results? (?:matched|were found|found)|\b(?:check the spelling|use fewer terms)\b|\byour search\b.{0,40}\b(?:no|did not)\b"
    r"|\b(?:under|for|scheduled|down for) maintenance\b|\bsystem (?:is )?(?:under|down)|\btoo many requests\b|\baddress has been limited|\b(?:rate limit|request limit)|\bunable to (?:load|open|display|connect)|\bsomething (?:went wrong|broke)|\boops\b|\bunexpected (?:error|problem)|\b(?:server|service)\b[^.]{0,30}\b(?:not respond|did not respond|unavailable|is down|timed out|overloaded)|\bbad gateway\b|\binternal (?:server )?error\b|\bgateway time-?out\b|\bbad request\b|\brefresh (?:the|this) page\b|\bcontact the administrator\b|\breturn to the (?:index|home)|\blink you followed|\bincident code\b|\bsorry for the inconvenience\b|\bwe apologi[sz]e for"
    r"|\b(?:enable|turn on|activate|requires?|needs?|allow)\b[^.]{0,40}\b(?:javascript|scripts?|cookies|scripting)|\b(?:javascript|scripts?|scripting|cookies)\b[^.]{0,40}\b(?:disabled|required|enabled|must be|is off|not supported|turned off)|\bbrowser\b[^.]{0,40}\b(?:not support|outdated|unsupported)|\bchecking (?:your|the) browser|\bverify(?:ing)? (?:that )?you (?:are|'re) (?:a )?human|\bare you (?:a robot|human)|\bsecurity check\b|\bcaptcha\b|\bmay take a few seconds\b|\bplease wait while\b|\breload the page\b|\bloading…"
    r"|traceback \(most recent|^\s*file \"[^\"]+\", line \d+|\b[A-Z]\w+(?:Error|Exception)\b\s*:|^\s*at [\w.$]+\([\w.]+:\d+\)|\b(?:warning|fatal error|notice)\b: .*\b(?:expects|on line|undefined|failed)|\bORA-\d{5}|\bSQLSTATE|\bstack trace\b|\bexpects parameter\b|\bon line \d+"
    r"|δεν (?:έχετε|υπάρχει) (?:δικαίωμα|άδεια)|δικαίωμα πρόσβασης|(?:η )?πρόσβαση (?:δεν επιτρέπεται|απαγορεύεται|απορρίφθηκε)|συνεδρία (?:σας )?(?:έληξε|έχει λήξει)|συνδεθείτε (?:ξανά|πάλι|για)|δεν βρέθηκαν αποτελέσματα|ελέγξτε την ορθογραφία|λιγότερους όρους|σε συντήρηση|εργασίες συντήρησης|συγγνώμη για την|(?:σελίδα|απόφαση|έγγραφο|αρχείο|διεύθυνση|σύνδεσμος)\b[^.]{0,50}(?:δεν βρέθηκε|δεν υπάρχει|μετακινήθηκε|έχει λήξει|προσωρινά|δεν αντιστοιχεί|δεν μπορεί να (?:προβληθεί|φορτωθεί))|σφάλμα (?:διακομιστή|συστήματος|\d)|μη έγκυρο αίτημα|απρόσμενο (?:πρόβλημα|σφάλμα)|δοκιμάστε (?:ξανά|πάλι|αργότερα|άλλον)|(?:διακομιστής|υπηρεσία)\b[^.]{0,40}(?:δεν ανταποκρίθηκε|δεν είναι διαθέσιμ|μη διαθέσιμ)|αδυναμία φόρτωσης|ανανεώστε τη σελίδα|επικοινωνήστε με τον διαχειριστή|κωδικός (?:συμβάντος|αναφοράς|σφάλματος)|πάρα πολλά αιτήματα|πολλά αιτήματα|περιορίστηκε|επιστρέψτε στ|κάτι πήγε στραβά"
    r"|(?:απαιτείται|ενεργοποι\w+|χρειάζεται|απαιτεί)\b[^.]{0,50}(?:javascript|σενάρι|cookies)|(?:javascript|σενάρια|cookies)\b[^.]{0,50}(?:ενεργοποιη|απαιτ|απενεργ)|δεν υποστηρίζει (?:σενάρια|javascript)|ενεργοποιήστε το|φορτώστε ξανά|έλεγχος ασφαλείας|επαληθεύουμε ότι|είστε άνθρωπος|έλεγχος (?:του )?(?:φυλλομετρητή|προγράμματος περιήγησης)|δευτερόλεπτα"
    r"|(?:sayfa|karar|belge|adres|dosya|bağlantı)\w*\b[^.]{0,50}(?:bulunamadı|taşınmış|silinmiş|süresi dolmuş|kilitli|karşılık gelmiyor|yüklenemedi|görüntülenemiyor)|eriş(?:im|me)\b[^.]{0,20}(?:reddedildi|engellendi|yetkiniz|izniniz)|yetkiniz yok|görüntüleme (?:yetkiniz|izniniz)|oturum\w*\b[^.]{0,20}(?:süresi doldu|sona erdi|kapandı)|(?:yeniden|tekrar) (?:oturum açın|giriş yapın|deneyin)|sonuç bulunamadı|yazımı (?:denetleyin|kontrol)|daha az terim|bakım(?:da|dadır| çalışması)|sunucu (?:hatası|zamanında|yanıt)|geçersiz istek|beklenmeyen|bir sorun oluştu|hizmet (?:kullanılamıyor|dışı)|sayfayı yenileyin|yöneticiye başvurun|olay kodu|başvuru kodu|çok fazla istek|dizine dönün|özür dileriz|belge yüklenemedi"
    r"|javascript\b[^.]{0,40}(?:etkin|gerek|açık)|betik\w*\b[^.]{0,30}(?:etkin|destekle|gerek|açın)|tarayıcı\w*\b[^.]{0,40}(?:desteklemiyor|denetleniyor|kontrol ediliyor|etkinleştir)|güvenlik denetimi|insan olduğunuz"
    r"|страница не найдена|доступ (?:запрещ[её]н|закрыт)|сеанс (?:ист[её]к|завершен)|включите javascript|ничего не найдено|техническ\w+ (?:обслуживани|работ)|сервер не отвечает|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|session (?:a )?expiré|activez javascript|aucun résultat|en maintenance|seite nicht gefunden|zugriff verweigert|sitzung (?:ist )?abgelaufen|javascript aktivieren|keine (?:ergebnisse|treffer)|wartungsarbeiten|pagina nu a fost găsită|acces (?:interzis|refuzat)|sesiunea a expirat|страницата не е намерена|достъпът е отказан|页面(?:未找到|不存在)|访问被拒绝|请启用|会话已过期|الصفحة غير موجودة|تم رفض الوصول|انتهت (?:صلاحية )?الجلسة"
)
_REMAINS = re.compile(
    r"(?i)^\W*(?:©|\(c\)|copyright)|\ball rights reserved|δικαιώματα διατηρούνται|hakları saklıdır|^\W*(?:last updated|updated on|τελευταία ενημέρωση|son güncelleme|visits|visitors|επισκέψεις|επισκέπτες|ziyaret\w*|page views)\W*[:\d]|portal is provided for information|no liability for|certified copies|παρέχεται για ενημέρωση|δεν φέρει ευθύνη|επίσημα αντίγραφα|bilgi amaçlıdır|sorumluluk kabul edilmez|onaylı (?:suret|örnek)|^\W*(?:home|search|contact|about us|legislation|recent rulings|sign in|αρχική|αναζήτηση|νομοθεσία|επικοινωνία|σχετικά με εμάς|πρόσφατες αποφάσεις|ana sayfa|arama|mevzuat|iletişim|hakkımızda|son kararlar)\W*$"
)
_MENU = re.compile(r"^[^|.!?]{1,40}(?:\s[|»›>·•]\s[^|.!?]{1,40})+$")
_CODE_ONLY = re.compile(r"^[\W\dA-F_]*$|^\W*(?:reference|ref|ray|id|κωδικός \w+|incident code|olay kodu|request id)\W+[\w-]+\W*$", re.I)


def _code(text: str) -> list[tuple[int, int]]:
    """Code in the text: marked up, or indented and holding control statements or announced by the line before."""
    found = [c.span() for c in _CODE.finditer(text)]
    if "\n    " in text or "\n\t" in text or text[:1] in " \t":
        for m in _INDENTED.finditer(text):
            before = text[: m.start()].rstrip().rpartition("\n")[2]
            if _CONTROL.search(m[0]) or before.endswith(":") or _SYNTAX.search(before):
                found.append(m.span())
    return found


def fields(text: str) -> list[tuple[str, int]]:
    """(kind, place) of the unfilled fields of ``text`` that are really some."""
    quoted = code = None
    out, explained = [], 0
    for start in _START.finditer(text):
        if not (m := _PLACEHOLDER.match(text, start.start())):
            continue
        kind, found = m.lastgroup, m[0]
        if _EDITORIAL.fullmatch(found) or kind == "angle" and re.fullmatch(r"</?(?:p|br|b|i|u|a|div|span|td|tr|table|ul|ol|li|h\d|html|body|head|title|em|strong|font|hr|code|pre)\s*>", found, re.I):
            continue
        if quoted is None:
            quoted, code = [q.span() for q in _QUOTED.finditer(text)], _code(text)
        a, b = m.span()
        if any(s <= a and b <= e for s, e in code):
            explained += 1
            continue
        if any(s < a and b < e and _WORDS.search(text[s:a] + " " + text[b:e]) for s, e in quoted):
            continue
        start = max(text.rfind(x, 0, a) for x in ("\n", ". ", "! ", "? ", "; ")) + 1
        end = min((e for x in ("\n", ". ", "! ", "? ") if (e := text.find(x, b)) >= 0), default=len(text))
        if _MENTION.search(text, start, end):
            continue
        around = _PLACEHOLDER.sub(" ", text[start:end])
        if _SYNTAX.search(around):
            explained += 1
            continue
        out.append((kind, a))
    return out if len(out) >= explained else []


def placeholder(text: str) -> str | None:
    """The kind of the first unfilled field of ``text`` that is really one."""
    found = fields(text)
    return found[0][0] if found else None


_WORDS = re.compile(r"[^\W\d_]+")


#: Beginnings of words that name parts of a site, of what may be the matter with them or is asked of the reader, and of negations.
SITE = tuple(
    "page javascript script scripting cookie browser server database connection http url captcha website webpage session login account request gateway firewall network robot"
    " σελίδα ιστοσελίδα ιστότοπο σενάρι φυλλομετρητ περιηγητ διακομιστ συνεδρία αίτημα σύνδεση διεύθυνση sayfa betik tarayıcı sunucu oturum veritaban bağlantı site erişim"
    " página pagina navegador servidor sesión sessão conexión script seite browser sitzung verbindung zugriff navigateur serveur connexion browserul sesiunea strona strony stronie przeglądark serwer sesja połączeni"
    " side siden sida sidan nettleser webbläsare sessie verbinding sivu sivua selain palvelin stránka stránku stránky prohlížeč oldal böngésző kiszolgáló страниц браузер сервер сеанс страницата връзка сървър".split()
)
FAULT = tuple(
    "error found denied expired disabled unavailable forbidden enable reload retry refresh failed missing moved removed blocked timeout maintenance overloaded offline unauthorized required invalid broken closed establishing timed gone"
    " σφάλμα βρέθηκε έληξε απορρίφθηκε ενεργοποι απενεργοποι ανανεώστε δοκιμάστε συντήρηση διαθέσιμ μετακιν κλειστ hata bulunamad reddedil engellen kapal etkin açın açınız yenile bakım geçersiz kullanılam taşın"
    " error encontrad denegad negad expirad caducad habilit disponible disponível mantenimiento manutenção trovata trovato negato scadut abilit disponibile manutenzione fehler gefunden verweigert abgelaufen aktivieren verfügbar wartung"
    " erreur introuvable trouvée refusé expiré activez indisponible eroare găsit refuzat expirat activați błąd znalezion odmowa wygasł włącz niedostępn fejl fundet nægtet udløbet aktiver funnet feil hittades nekad löpt fel fout gevonden geweigerd verlopen"
    " löydy löytynyt virhe vanhentunut chyba nalezena nenalezena vypršela hiba található lejárt ошибка найден запрещ истек включите недоступ грешка намерен отказан изтекла".split()
)
NEGATION = frozenset("not no non nicht nie ne pas ikke inte ej niet ei není nem nu не нет δεν değil không nao não was is has been could be the a la le el die der das esta är er ist wurde blev kunne har".split())


_SITE_HEADS, _FAULT_HEADS = frozenset(w[:3] for w in SITE), frozenset(w[:3] for w in FAULT)


def _of_site(word: str) -> bool:
    return word[:3] in _SITE_HEADS and word.startswith(SITE)


def _of_fault(word: str) -> bool:
    return word[:3] in _FAULT_HEADS and word.startswith(FAULT)


#: A unit that reports what persons of a case said or found is content, whatever it quotes.
_REPORTED = re.compile(r"(?i)\b(?:witness|testif|told the|court (?:held|accept|found|not)|plaintiff|defendant|appellant|respondent|μάρτυρ|κατέθεσ|ενάγ|εναγ|εφεσείο|δικαστήριο (?:έκριν|δέχ|αποδ)|tanık|davacı|davalı|témoin|zeuge|kläger|свидетел|истец)")


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.replace("İ", "i").lower())


def _filler_words(words: list[str]) -> bool:
    known = [w for w in words if w in _FILLER_WORDS]
    return len(words) >= 4 and len(known) >= 0.35 * len(words) and len(set(known)) >= 2


def _site_message(words: list[str]) -> bool:
    """Parts of a site and faults make up half of the words."""
    site, fault = sum(map(_of_site, words)), sum(map(_of_fault, words))
    return site > 0 and fault > 0 and site + fault >= 0.5 * sum(w not in NEGATION for w in words)


def judge(text: str | None) -> tuple[str, float] | None:
    """('template', share of lines with a field) or ('message' or 'filler', density), else None."""
    if text is None or not text.strip():
        return None
    if found := fields(text):
        lines = [line for line in text.split("\n") if line.strip()]
        return "template", min(1.0, len({text.count("\n", 0, at) for _, at in found}) / len(lines))
    known = set(_words(text))
    fills = not _FILLER_WORDS.isdisjoint(known)
    sites = any(map(_of_site, known)) and any(map(_of_fault, known))
    if not fills and not sites and not _has_stem(text):
        return None
    share = dict.fromkeys(("message", "filler", "content"), 0)
    for line in text.split("\n"):
        line = line.strip()
        if not line or _MENU.match(line) or _REMAINS.search(line):
            continue
        for unit in _SENTENCE.split(line):
            if not unit.strip() or _CODE_ONLY.match(unit) or _REMAINS.search(unit):
                continue
            plain = _QUOTED.sub(" ", unit)
            hinted = _has_stem(plain)
            words = _words(plain) if fills or sites else []
            if hinted and _FILLER.search(plain) or fills and _filler_words(words):
                share["filler"] += len(unit)
            elif (hinted and _MESSAGE.search(plain) or sites and _site_message(words)) and not _REPORTED.search(plain):
                share["message"] += len(unit)
            else:
                share["content"] += len(unit)
    bad = share["message"] + share["filler"]
    density = bad / max(1, bad + share["content"])
    if bad and density >= DENSITY:
        return max(("filler", "message"), key=share.get), density
    return None


def residue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, density) of the rows to exclude; one pass, no shuffle."""
    kind = documents.schema[id_col].dataType.simpleString()

    def factory():
        def chunk(cols):
            out = [(i, *v) for i, t in zip(*cols) if (v := judge(t))]
            return list(zip(*out)) if out else ([], [], [])

        return chunk

    return arrow_map(documents, [id_col, text_col], f"{id_col} {kind}, kind string, density double", factory)
