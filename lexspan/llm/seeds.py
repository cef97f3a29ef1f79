"""Short texts written for this project, one for each language, that start the trained models.

They are only a start: :mod:`.charmodel` and :mod:`.languages` select reliable records of the data
with them and train on those records and these texts together.
"""

SEEDS = {
    "el": """Την Παρασκευή το πρωί οι γείτονες μαζεύτηκαν στην πλατεία του χωριού για να συζητήσουν το νέο σχολείο. Ο δήμαρχος είπε ότι τα χρήματα δεν φτάνουν, αλλά η επιτροπή θεωρεί πως η οικοδομή μπορεί να αρχίσει μέσα στο καλοκαίρι. Σύμφωνα με την έκθεση, κάθε οικογένεια θα πληρώσει ένα μικρό ποσό και το υπόλοιπο θα το δώσει το κράτος. Όταν τελείωσε η συνάντηση, μερικοί έμειναν εκεί μέχρι αργά, γιατί ήθελαν να ακούσουν τι σκέφτονται οι άλλοι. «Δεν ξέρω αν πρέπει να υπογράψουμε», ανέφερε η δασκάλα, ενώ ο αδελφός της υποστήριξε την αντίθετη άποψη. Η απόφαση του δικαστηρίου για την υπόθεση αυτή αναμένεται, ωστόσο καμία από τις δύο πλευρές δεν φαίνεται πρόθυμη να υποχωρήσει. Κατά την ακρόαση εξετάστηκαν οι μάρτυρες, τα έγγραφα και οι όροι της συμφωνίας.""",
    "en": """On Friday morning the neighbours met in the village square to talk about the new school. The mayor said that there was not enough money, but the committee thinks the building could begin during the summer. According to the report, every family would pay a small amount and the state would give the rest. When the meeting was over, some of them stayed there until late because they wanted to hear what the others thought. "I do not know whether we should sign," the teacher said, while her brother took the opposite view. The judgment of the court in this case is expected soon; however, neither of the parties seems willing to give way. At the hearing the witnesses, the documents and the terms of the agreement were examined.""",
    "tr": """Cuma sabahı komşular yeni okulu konuşmak için köy meydanında toplandı. Belediye başkanı paranın yetmediğini söyledi, ancak kurul inşaatın yaz aylarında başlayabileceğini düşünüyor. Rapora göre her aile küçük bir tutar ödeyecek, geri kalanını ise devlet verecek. Toplantı bittiğinde bazıları başkalarının ne düşündüğünü dinlemek istediği için geç saatlere kadar orada kaldı. Öğretmen "imzalamamız gerekip gerekmediğini bilmiyorum" dedi, oysa kardeşi karşı görüşü savundu. Mahkemenin bu davadaki kararı bekleniyor; bununla birlikte taraflardan hiçbiri geri adım atmaya istekli görünmüyor. Duruşma sırasında tanıklar, belgeler ve sözleşmenin koşulları incelendi.""",
    "ru": """В пятницу утром соседи собрались на сельской площади, чтобы обсудить новую школу. Глава администрации сказал, что денег не хватает, но комиссия считает, что строительство может начаться уже летом. Согласно отчёту, каждая семья заплатит небольшую сумму, а остальное выделит государство. Когда собрание закончилось, некоторые остались там допоздна, потому что хотели услышать, что думают другие. «Я не знаю, следует ли нам подписывать», — сказала учительница, тогда как её брат придерживался противоположного мнения. Решение суда по этому делу ожидается, однако ни одна из сторон не готова уступить. Во время заседания были изучены показания свидетелей, документы и условия договора.""",
    "bg": """В петък сутринта съседите се събраха на селския площад, за да обсъдят новото училище. Кметът каза, че парите не достигат, но комисията смята, че строежът може да започне още през лятото. Според доклада всяко семейство ще плати малка сума, а останалото ще даде държавата. Когато събранието свърши, някои останаха там до късно, защото искаха да чуят какво мислят другите. „Не зная дали трябва да подпишем“, каза учителката, докато брат ѝ поддържаше обратното мнение. Решението на съда по това дело се очаква, но нито една от страните не изглежда готова да отстъпи. По време на заседанието бяха разгледани показанията на свидетелите, документите и условията на договора.""",
    "fr": """Vendredi matin, les voisins se sont réunis sur la place du village pour parler de la nouvelle école. Le maire a dit qu'il n'y avait pas assez d'argent, mais la commission pense que les travaux pourraient commencer pendant l'été. Selon le rapport, chaque famille paierait une petite somme et l'État donnerait le reste. Lorsque la réunion fut terminée, certains sont restés là jusque tard parce qu'ils voulaient entendre ce que pensaient les autres. « Je ne sais pas si nous devons signer », a déclaré l'institutrice, tandis que son frère soutenait l'avis contraire. La décision du tribunal dans cette affaire est attendue; toutefois aucune des parties ne semble prête à céder. À l'audience, les témoins, les pièces et les conditions du contrat ont été examinés.""",
    "de": """Am Freitagmorgen trafen sich die Nachbarn auf dem Dorfplatz, um über die neue Schule zu sprechen. Der Bürgermeister sagte, dass das Geld nicht reiche, aber der Ausschuss meint, der Bau könne noch im Sommer beginnen. Nach dem Bericht würde jede Familie einen kleinen Betrag zahlen und den Rest gäbe der Staat. Als die Versammlung zu Ende war, blieben einige bis spät dort, weil sie hören wollten, was die anderen dachten. „Ich weiß nicht, ob wir unterschreiben sollen“, sagte die Lehrerin, während ihr Bruder die gegenteilige Ansicht vertrat. Die Entscheidung des Gerichts in dieser Sache wird erwartet, jedoch scheint keine der Parteien nachgeben zu wollen. In der Verhandlung wurden die Zeugen, die Urkunden und die Bedingungen des Vertrags geprüft.""",
    "ro": """Vineri dimineață vecinii s-au adunat în piața satului pentru a vorbi despre noua școală. Primarul a spus că banii nu ajung, dar comisia crede că lucrările ar putea începe chiar în timpul verii. Potrivit raportului, fiecare familie ar plăti o sumă mică, iar restul l-ar da statul. Când adunarea s-a încheiat, unii au rămas acolo până târziu, fiindcă voiau să audă ce gândesc ceilalți. „Nu știu dacă trebuie să semnăm”, a declarat învățătoarea, în timp ce fratele ei susținea părerea contrară. Hotărârea instanței în această cauză este așteptată; totuși niciuna dintre părți nu pare dispusă să cedeze. La ședință au fost examinați martorii, înscrisurile și condițiile contractului.""",
    "ar": """في صباح يوم الجمعة اجتمع الجيران في ساحة القرية للحديث عن المدرسة الجديدة. قال رئيس البلدية إن المال لا يكفي، لكن اللجنة ترى أن البناء يمكن أن يبدأ خلال الصيف. وبحسب التقرير ستدفع كل عائلة مبلغًا صغيرًا وستقدم الدولة الباقي. وعندما انتهى الاجتماع بقي بعضهم هناك حتى وقت متأخر لأنهم أرادوا أن يسمعوا رأي الآخرين. قالت المعلمة: «لا أعرف هل ينبغي أن نوقّع»، بينما أيّد أخوها الرأي المخالف. ومن المنتظر صدور حكم المحكمة في هذه القضية، غير أن أيًا من الطرفين لا يبدو مستعدًا للتراجع. وخلال الجلسة فُحصت أقوال الشهود والمستندات وشروط الاتفاق.""",
    "zh": """星期五早上，邻居们聚集在村里的广场上，讨论新学校的事情。村长说钱不够，但是委员会认为工程可以在夏天开始。根据报告，每个家庭要付一小笔钱，其余的由国家支付。会议结束以后，有些人一直留到很晚，因为他们想听听别人的想法。老师说：“我不知道我们应不应该签字。”她的哥哥却持相反的意见。法院对此案的判决即将作出，然而双方当事人似乎都不愿意让步。在庭审期间，审查了证人、文件以及合同的条款。原告和被告都提交了证据，法官驳回了延期的请求，并且确认了赔偿的数额。""",
    "hi": """शुक्रवार की सुबह पड़ोसी नए विद्यालय के बारे में बात करने के लिए गाँव के चौक में इकट्ठा हुए। मुखिया ने कहा कि पैसा पर्याप्त नहीं है, लेकिन समिति का मानना है कि निर्माण गर्मियों में शुरू हो सकता है। रिपोर्ट के अनुसार हर परिवार एक छोटी राशि देगा और बाकी राज्य देगा। जब बैठक समाप्त हुई तो कुछ लोग देर तक वहीं रहे, क्योंकि वे दूसरों के विचार सुनना चाहते थे। शिक्षिका ने कहा, "मुझे नहीं पता कि हमें हस्ताक्षर करने चाहिए या नहीं", जबकि उसके भाई ने विपरीत मत रखा। इस मामले में न्यायालय के निर्णय की प्रतीक्षा है, तथापि कोई भी पक्ष झुकने को तैयार नहीं दिखता। सुनवाई के दौरान गवाहों, दस्तावेज़ों और अनुबंध की शर्तों की जाँच की गई।""",
    "th": """เช้าวันศุกร์เพื่อนบ้านมารวมตัวกันที่ลานหมู่บ้านเพื่อพูดคุยเรื่องโรงเรียนใหม่ ผู้ใหญ่บ้านกล่าวว่าเงินไม่พอ แต่คณะกรรมการเห็นว่าการก่อสร้างอาจเริ่มได้ในช่วงฤดูร้อน ตามรายงานทุกครอบครัวจะจ่ายเงินจำนวนเล็กน้อยและรัฐจะจ่ายส่วนที่เหลือ เมื่อการประชุมสิ้นสุดลงบางคนยังอยู่จนดึกเพราะอยากฟังความคิดเห็นของคนอื่น ครูกล่าวว่าไม่รู้ว่าเราควรลงนามหรือไม่ ในขณะที่พี่ชายของเธอเห็นตรงกันข้าม คาดว่าศาลจะมีคำพิพากษาในคดีนี้ อย่างไรก็ตามไม่มีฝ่ายใดยอมถอย ในระหว่างการพิจารณาได้มีการตรวจสอบพยาน เอกสาร และเงื่อนไขของสัญญา""",
    "hy": """Ուրբաթ առավոտյան հարևանները հավաքվեցին գյուղի հրապարակում՝ նոր դպրոցի մասին խոսելու համար։ Գյուղապետն ասաց, որ գումարը չի բավականացնում, բայց հանձնաժողովը կարծում է, որ շինարարությունը կարող է սկսվել ամռանը։ Ըստ զեկույցի՝ յուրաքանչյուր ընտանիք կվճարի փոքր գումար, իսկ մնացածը կտա պետությունը։ Երբ ժողովն ավարտվեց, ոմանք մնացին այնտեղ մինչև ուշ, որովհետև ուզում էին լսել, թե ինչ են մտածում մյուսները։ «Չգիտեմ՝ արդյոք պետք է ստորագրենք», ասաց ուսուցչուհին, մինչդեռ նրա եղբայրը հակառակ կարծիքին էր։ Այս գործով դատարանի վճիռը սպասվում է, սակայն կողմերից ոչ մեկը պատրաստ չէ զիջել։ Նիստի ընթացքում քննվեցին վկաները, փաստաթղթերը և պայմանագրի պայմանները։""",
}
