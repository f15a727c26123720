"""Words of the abuse grammar, by class and language: fixed values, as plain text.

A line names its language and how its words inflect: `x` as written, `n` nouns,
`a` adjectives, `v` verbs. llm.inflect makes the forms. Surfaces are parted by
semicolons; Chinese ones count anywhere, all others only as whole words.
No class holds whole sentences: what is said of whom is for llm.abuse to parse.
"""

from __future__ import annotations

CLASSES = {
    # -- persons ---------------------------------------------------------------
    "YOU": """
        en x: you; u; ya; y'all; ye; thou; you guys; you people
        fr x: tu; t'; te; toi; vous
        de x: du; dich; dir; euch; ihr
        ru x: ты; тебя; тебе; тобой; вы; вас; вам; вами
        es x: eres; sois; usted; ustedes; vosotros
        it x: sei; siete; tu; ti; vi; voi
        zh x: 你; 妳; 您; 你们; 妳们; 楼上; 楼主; 你这; 你个; 你这个; 你这种; 你就
    """,
    "YOUR": """
        en x: your; yer; ur
        fr x: ton; ta; tes; votre; vos
        de x: dein; deine; deinen; deinem; deiner; deines; eure; euren; eurem; eurer; euer
        ru x: твой; твоя; твоё; твои; твоего; твоей; твоему; твою; твоих; твоим; ваш; ваша; ваше; ваши; вашего; вашей; вашу; ваших; вашим; твоими; твоём; вашими; вашему; ваши; твоего
        es x: tus; vuestro; vuestra; vuestros; vuestras
        it x: tuo; tua; tuoi; tue; vostro; vostra; vostri
        zh x: 你的; 你家; 你们家; 你公司; 你全家; 你们全家; 你女儿; 你儿子; 你老婆; 你妈; 你爸; 你爹; 你房子; 你老家; 你妈的; 你狗命; 你儿女
    """,
    "REFL": """
        en x: yourself; yourselves; urself
        fr x: te; vous
        de x: dich; euch
        ru x: себя; себе
        es x: te; os
        zh x: 自己; 你自己
    """,
    "THIRD": """
        en x: he; him; she; her; his; he's; that guy; this guy; that man; that woman; this man; this woman; that bitch; that bastard
        fr x: il; elle; lui; cet homme; cette femme; ce type; ce mec
        de x: er; ihn; ihm; sie; sein; seine; seinen; diesen kerl; dieser kerl; den kerl; der kerl; dieser mann; diese frau; diese tussi
        ru x: он; она; его; её; ему; ей; этот человек; эта женщина; этого
        es x: él; ella; este tipo; ese tipo; esa mujer; ese hombre
        it x: lui; lei; quel tipo; questo tipo; quella donna
        zh x: 他; 她; 这个人; 那个人; 这家伙; 那家伙; 这厮; 那个女的; 那个男的; 这女的; 这男的
    """,
    "THEY": """
        en x: they; them; these people; those people; people like that; their kind; whoever
        fr x: ils; elles; eux; ces gens; ces gens-là
        de x: die da; diese leute; solche leute; solches pack; dieses pack
        ru x: они; их; им; эти люди; таких; такие; этих людей; всех их; их всех
        es x: ellos; ellas; esa gente; echarlos
        it x: loro; questa gente; cacciateli
        zh x: 他们; 她们; 这帮; 这群; 这种人; 那种人; 这些人; 那些人; 这帮人; 这群人; 那帮; 那群; 的人
    """,
    "ROLE": """
        en n: chairman; chairwoman; chair; ceo; cfo; boss; director; board; management; manager; executive; analyst; author; adviser; advisor; consultant; moderator; admin; poster; shareholder; investor; president; minister; politician; journalist; employee; colleague; neighbour; neighbor; customer; teacher; judge; cop; officer; banker; lawyer; broker; trader; founder; owner; mother; father; wife; husband; sister; brother; daughter; son; leadership; staff; crew; guy; dude; woman; girl; man
        en x: this board; those guys; who; everyone here; everybody here; men; women; mom; mum; dad; everybody; everyone; anybody who; anyone who; every one of them; committee; the whole lot; half of them
        fr n: président; directeur; directrice; patron; chef; ministre; analyste; auteur; conseiller; gérant; actionnaire; journaliste; politicien; mère; père; sœur; frère; femme; mari; voisin; collègue; dirigeant; administrateur; type; mec
        fr x: direction; conseil; la direction; le conseil; chacun; tout le monde; le comité; la chef; cette bonne femme
        de n: vorstand; chef; chefin; direktor; aufsichtsrat; berater; analyst; autor; minister; präsident; moderator; politiker; journalist; aktionär; kollege; nachbar; nachbarin; mutter; vater; leitung; geschäftsführung; geschäftsführer; kerl; typ; weib; mann
        de x: vorstände; im vorstand; chefs; management; jeder; alle hier; der ganze verein; der laden; die alte; der alte; die chefin
        ru n: директор; председател; начальник; шеф; президент; министр; аналитик; автор; менеджер; модератор; акционер; журналист; политик; чиновник; мат; отец; сосед; соседк; коллег; мужик; бабк
        ru x: правление; правлении; правления; руководство; руководстве; мать; мужики; каждый; все здесь; комитет; начальство; бухгалтер; бухгалтеры
        es n: jefe; jefa; director; directora; presidente; gerente; ministro; analista; autor; periodista; político; vecino; vecina
        es x: la dirección; el consejo
        it n: capo; direttore; presidente; ministro; analista; autore; giornalista; politico; vicino; dirigente
        it x: la direzione; il consiglio
        zh x: 董事长; 董事会; 管理层; 老板; 总裁; 总经理; 董秘; 分析师; 作者; 版主; 主任; 经理; 领导; 部长; 记者; 邻居; 同事; 股东; 高管; 会计; 专家; 全家; 女主持; 这公司; 每个人; 所有人; 委员会; 总监; 财务总监; 同学; 科长; 局长; 校长; 老师; 医生; 律师
    """,
    "KIN": """
        en n: kid; child; daughter; son; wife; husband; mother; father; family; parent; sister; brother
        en x: children; mom; mum; dad; wives
        fr n: enfant; fille; fils; femme; mari; mère; père; famille; gosse; gamin
        de n: kind; tochter; sohn; frau; mann; mutter; vater; familie; eltern
        de x: kinder; kindern; töchter; söhne
        ru n: дет; доч; сын; жен; муж; мат; отец; семь; ребёнк
        ru x: дети; детей; жену; мать; детьми; детям; семьёй; семью; дочь; дочку; сына; мужа; маму
        es x: hijos; hija; hijo; mujer; marido; madre; padre; familia
        it x: figli; figlia; figlio; moglie; marito; madre; padre; famiglia
        zh x: 女儿; 儿子; 孩子; 老婆; 老公; 全家; 家人; 妈; 爸; 父母
    """,
    "SELF": """
        en x: i; we; i'll; we'll; i'd; we'd; i'm gonna; imma; someone should; somebody should; somebody ought to; someone ought to
        fr x: je; j'; nous; on va; on vous; on te; on le; on la; on les; on lui; on devrait; on sait; qu'on; on sait; on connaît
        de x: ich; wir; man sollte; man müsste; jemand sollte
        ru x: я; мы; мне; нам; кто-нибудь
        es x: voy a; vamos a; yo; nosotros; quiero; habría que
        it x: vado a; andiamo a; io; noi; voglio; vogliamo
        zh x: 我; 我们; 俺; 老子; 咱; 咱们; 爷; 劳资
    """,
    "GROUP": """
        en n: woman; foreigner; immigrant; migrant; refugee; southerner; northerner; easterner; westerner; islander; cripple; jew; muslim; arab; homosexual; lesbian; gypsy; peasant; villager; outsider; newcomer; pensioner; catholic; christian; hindu; feminist; transsexual; transgender; foreign worker; migrant worker
        en x: women; old people; the elderly; elderly people; disabled people; the disabled; black people; chinese people; country people; mountain people; the poor; poor people; trans people; the blind; the deaf; gypsies; rednecks; girls; the homeless; homeless people; africans; mexicans; indians; asians; blacks; turks; seniors; females; gays; chinks
        fr n: étranger; étrangère; immigré; migrant; réfugié; handicapé; arabe; juif; musulman; homosexuel; gitan; tsigane; paysan; nordiste; sudiste; asiatique; insulaire; africain; turc; chinois; chinoise; polonais
        fr x: femmes; les vieux; vieilles; les pauvres; juive; juives; provinciaux; les femmes; les gays; bonnes femmes; noirs; les noirs; roms; les roms
        de n: ausländer; behindert; migrant; flüchtling; rentner; jude; muslim; moslem; schwul; zigeuner; türke; ossi; wessi; südländer; inselbewohner; weib; asylant; zugezogen; afrikaner; araber; chinese; obdachlos; homosexuell
        de x: frauen; alte leute; alten leute; fremde; zigeunerpack; ausländerpack; alten menschen; judenpack; die schwarzen; neger; polen; polacken; bauern; roma
        ru n: инвалид; женщин; баб; мигрант; старик; евре; мусульман; кавказц; чурк; хач; гомосексуалист; цыган; южан; северян; островитян; иностранц; беженц; азиат; негр; пенсионер; таджик; узбек; китайц; поляк; араб; бомж
        ru x: цыгане; южане; северяне; островитяне; мусульмане; геи; евреи; еврей; стариков; приезжие; приезжих; понаехавшие; приезжим; гей; геев; деревенские; деревенских
        es n: inmigrante; extranjer; gitan; judí; musulman; moro; negr; homosexual; refugiad; minusválid; sudaca
        es x: mujeres; los viejos; las mujeres; judíos
        it n: immigrat; stranier; zingar; ebre; musulman; negr; arab; rifugiat; disabil; omosessual; albanes; terron
        it x: donne; i vecchi; le donne; ebrei; zingari; stranieri
        zh x: 女人; 妇女; 外地人; 移民; 乡下人; 残疾人; 老头; 老人; 老太婆; 岛民; 外国人; 黑人; 穷人; 农民工; 同性恋; 难民; 北方人; 南方人; 乡巴佬; 少数民族; 犹太人; 穆斯林; 老外; 打工妹; 女司机; 山里人; 外来人; 瘸子; 瞎子; 河南人; 东北人; 上海人; 印度人; 日本人; 非洲人; 农村人; 娘们
    """,
    # -- insults ---------------------------------------------------------------
    "INSULT": """
        en n: idiot; moron; imbecile; fool; bastard; bitch; loser; cretin; dimwit; halfwit; nitwit; slut; whore; cunt; prick; twat; wanker; freak; scum; crook; liar; coward; thief; clown; degenerate; simpleton; buffoon; dunce; swindler; scammer; weasel; leech; creep; pervert; jerk; tosser; bellend; knob; lowlife; airhead; bimbo; numbskull; cockwomble; hag; tramp; skank; weirdo; pissant; hypocrite; charlatan; fraudster; con man; traitor; rapist; sociopath; psychopath; bozo; dolt; dullard; nutjob; bum; bloodsucker; rapist; stooge; cheat; lunatic; ingrate; sellout; hack
        en x: thieves; half-wit; half-wits; dirtbag; dirtbags; nobody but a; sleazebag; good-for-nothing
        fr n: connard; idiot; crétin; imbécile; ordure; pute; abruti; débile; bouffon; voleur; escroc; minable; garce; lâche; menteur; menteuse; salaud; pourri; raté; incapable; charlatan; clown; guignol; traînée; pétasse; blaireau; andouille; tocard; fumier; enfoiré; bâtard; gros con; gros porc; traître; hypocrite; ivrogne; parasite; larbin; branquignol; magouilleur; faux-cul; lèche-cul; vautour; débris; cloporte; tyran
        fr x: conne; connes; nazes; voleuse; charogne; déchet de l'humanité; un con; le con; gros con; pauvre con; ce con; sale con; les cons; des cons; quel con; est con; es con; êtes cons; de cons; cons
        de n: idiot; trottel; schwachkopf; dummkopf; vollpfosten; schlampe; hure; penner; versager; abschaum; drecksack; spast; mistkerl; lump; betrüger; feigling; lügner; lügnerin; verbrecher; gauner; witzfigur; depp; volldepp; dämlack; hohlkopf; pfeife; arsch; nichtsnutz; taugenichts; blödmann; kotzbrocken; schmarotzer; waschlappen; clown; dieb; dreckskerl; miststück; bastard; zicke; flasche; heuchler; pfuscher; stümper; halsabschneider; schleimer; blender; volltrottel; armleuchter; spinner; verräter; arschkriecher; dreckfresser; hornochse; vollhorst; flitzpiepe
        de x: schwachköpfe; dummköpfe; drecksäcke; feiglinge; hohlköpfe; der letzte dreck; letzter dreck; blödmänner; ärsche
        ru n: идиот; дурак; дур; тупиц; дебил; кретин; твар; урод; скотин; подонок; подонк; вор; мраз; жулик; трус; лжец; врун; ничтожеств; негодя; клоун; лох; придурок; придурк; мошенник; мерзавец; мерзавц; гнид; паскуд; болван; баран; дегенерат; олух; бездар; бездельник; шлюх; шалав; гад; козл; ублюдок; тряпк; лицемер; уродин; подлец; тунеядц; холуй; упыр; бестолоч; насильник; предател; шавк; недоучк
        ru x: козёл; козлы; быдло; дурачьё; жульё; ворьё; отребье; дебилы; вруны; тварь; мразь; бездарь
        es n: idiot; imbécil; estúpid; payas; ladr; cobarde; mentiros; cabr; zorr; put; inútil; gilipollas; canall; miserabl; tont; basur
        es x: ladrón; ladrones; cabrón; cabrones; imbécil; imbéciles; basura; mierda; inútil; inútiles
        it n: idiot; imbecill; cretin; stupid; pagliacc; ladr; codard; bugiard; bastard; puttan; trol; verm; deficient; fess; coglion; stronz
        zh x: 废物; 白痴; 蠢猪; 蠢货; 笨蛋; 畜生; 人渣; 败类; 骗子; 煞笔; 傻b; s.b; s.b.; sb; 脑残; 智障; 混蛋; 王八; 傻瓜; 弱智; 狗东西; 猪脑子; 猪脑; 窝囊废; 垃圾人; 小人; 孬种; 懦夫; 饭桶; 草包; 无赖; 流氓; 小丑; 狗腿子; 走狗; 贱人; 婊子; 贱货; 变态; 神经病; 二百五; 臭虫; 蠢材; 蠢驴; 吸血鬼; 骗子东西; 傻子; 疯狗; 恶棍; 丑八怪; 死胖子; 缩头乌龟; 老不死; 贼; 卑鄙小人; 蠢才; 叛徒; 强盗; 伪君子; 无赖汉; 吃货; 软蛋; 怂货; 白眼狼; 疯子; 老东西; 马屁精; 渣男; 泼妇; 狗官; 老狐狸; 傻叉; 傻缺; 大傻; 臭傻子; 猪头
    """,
    # words that insult a person only where a person is said to be one
    "BEAST": """
        en n: pig; rat; cow; dog; ape; monkey; worm; snake; swine; goat; donkey; sheep; toad; pest; parasite; vermin; trash; garbage; filth; dirt; vulture; hyena; cockroach; maggot; turd; waste of space; waste of oxygen; waste of air; sheep; witch; animal; savage; piece of garbage; piece of trash; disgusting person; failure as a human being; tool; muppet; sheep; donkey; lemming
        en x: swine; lice
        fr n: porc; chien; chienne; vache; rat; cochon; singe; serpent; parasite; vermine; cafard; larve; vautour; déchet; truie; âne; merde; bon à rien; tas de merde; thon; boudin; fumier; limace
        fr x: animaux; porcs; chiens
        de n: schwein; hund; kuh; ratte; sau; affe; schlange; esel; parasit; wurm; tier; dreck; müll; abfall; ungeziefer; geier; ziege; wurst; krücke; lappen; laus
        de x: kühe; würmer; hunde; läuse
        ru n: свинь; свине; собак; коров; крыс; обезьян; червь; черв; зме; осёл; осл; паразит; тараканы; таракан; скот; животн; мусор; гряз; падаль; овц; овец; шакал; курица; гиен; пёс; пс; кобыл; мешок дерьма; кляч; вешалк; обезьян; крокодил
        ru x: овца; свинья; свиньи; псина; дерьмо; говно; отбросы; сброд
        es n: cerd; perr; vac; rata; parásit; mono; gusan; animal; burr; escoria; cucaracha
        es x: ratas; cucarachas; burro; bestias
        it n: maial; cane; vacca; ratt; topo; scimmia; parassit; asin; feccia; spazzatur; bestia; verme
        it x: cani; parassiti; bestie; scarafaggi; rifiuti; ratti; topi; vermi
        zh x: 猪; 狗; 垃圾; 蠢驴; 害虫; 寄生虫; 蛀虫; 蟑螂; 老鼠; 禽兽; 毒瘤; 畜牲; 牲口; 渣滓; 渣子; 脏东西; 烂货; 癞蛤蟆; 母猪; 母狗; 牲畜; 狗屎
    """,
    "THING": """
        en x: thing; things; creature; creatures; excuse for; waste; lot
        fr x: chose; créature; types; gens
        de x: ding; wesen; gestalt; typen; weiber; leute
        ru x: создание; тварь; существо; людишки; морда; рожа
        zh x: 东西; 家伙; 玩意; 玩意儿; 女人; 男人; 胖子; 老头
    """,
    # words that degrade a person in an attribute
    "FOUL": """
        en x: stupid; dumb; dumber; dumbest; brain-dead; braindead; brainless; worthless; pathetic; retarded; filthy; ugly; spineless; disgusting; gutless; despicable; moronic; idiotic; mindless; repulsive; scummy; subhuman
        fr x: stupide; stupides; bête; bêtes; connes; débile; débiles; pathétique; pathétiques; répugnant; répugnante; dégueulasse; minable; minables; ignoble; hideux; abruti; crétine
        de a: dumm; blöd; dämlich; erbärmlich; hässlich; hirnlos; ekelhaft; widerlich; armselig; jämmerlich; bescheuert; doof; verblödet; geistesgestört; saublöd
        de x: saudumm; strohdumm; strunzdumm
        ru a: туп; жалк; вонюч; мерзк; безмозгл; никчёмн; уродлив; конченн; убог; отвратительн; гнусн; ебан; дебильн
        ru x: конченый; конченая; конченые; тупорылый; глуп; глупа; глупы
        es n: estúpid; asqueros; repugnant; patétic; tont; imbécil
        it n: stupid; schifos; disgustos; patetic; cretin; idiot
        zh x: 蠢; 笨; 傻; 恶心; 不要脸的; 不要脸; 无耻; 愚蠢的; 愚蠢; 卑鄙; 下贱; 没脑子的; 没脑子; 丑陋; 低能; 没教养的; 没教养; 猥琐; 脑残的; 没用的; 没用; 该死的; 无能的
    """,
    "MEAN": """
        en x: dirty; fat; lying; slimy; miserable; stinking; rotten; lazy; ignorant; clueless; useless; vile; crazy; insane; greedy; corrupt; whiny; sick; damn; damned; goddamn; bloody; fucking; effing; fuckin; cowardly; smelly; hideous; thick; disgraceful; sleazy; little; old; complete; total; utter; absolute; real; worthless; poor; arrogant; sad; bitter; cheap; crooked; backstabbing; sorry; incompetent; born
        fr x: sale; sales; pauvre; pauvres; gros; grosse; vieux; vieille; lamentable; puant; puante; nul; nulle; nuls; corrompu; corrompus; fini; vraie; vrai; putain de; petit; petite; espèce de; sombre; parfait; complet
        de a: dreckig; elend; fett; faul; verlogen; mies; verdammt; stinkend; feige; korrupt; behindert; hohl; unfähig; krank; verkommen; verfickt; alt; klein; komplett; total; absolut; arm; echt; schäbig
        de x: scheiß; drecks; doch alle; alle
        ru a: грязн; жирн; подл; ленив; больн; стар; продажн; лжив; сран; проклят; полн; настоящ; старающ; мелк; дран; тощ
        ru x: чёртов; чертов; жалкий; тупой
        es n: suci; maldit; gord; fe; viej; inútil; pobre; corrupt
        it n: sporc; maledett; grass; brutt; vecchi; povero; luri; vigliacc
        zh x: 脏; 臭; 贱; 丑; 狗屁; 死; 老; 没良心; 肮脏; 大; 小; 破; 烂
    """,
    "DEGREE": """
        en x: complete; total; nothing but; nothing more than; just; only; merely
        fr x: tous; toutes; rien que; qu'un; qu'une; que des
        de x: nur; lauter; alle; allesamt; nichts als; bloß; doch
        ru x: просто; одни; полный; полная; полные; сплошные; сплошь; только; все; настоящий; настоящие; обычный; всего лишь
        es x: solo; todos; puro; pura
        it x: solo; tutti; soltanto
        zh x: 都; 全; 就; 简直; 纯粹; 十足; 根本
    """,
    # words that degrade wherever they stand
    "SLUR": """
        en n: asshole; arsehole; dickhead; scumbag; motherfucker; shithead; dumbass; douchebag; retard; fuckwit; fuckface; cocksucker; jackass; shitbag; bitchass; dipshit; asswipe; nigger; faggot; kike; chink; wetback; towelhead; raghead; sandnigger; tranny; piece of shit; pile of shit; sack of shit; pieceofshit; libtard; dumbfuck; shitface; cumdumpster; fuckhead; stupidpig; dumbbitch
        en x: pieces of shit; piecesofshit; son of a bitch; sons of bitches; shit for brains; subhuman filth; sonofabitch; douche; stupid pig; stupid pigs; dumb bitch; dumb bitches; stupid bitch; stupid cunt
        fr n: connard; connasse; enculé; salopard; salaud; salope; bougnoule; youpin; négro; merdeux; branleur; tapette; pédé; tête de con; sous-merde; fils de pute; trou du cul; sac à merde
        de n: arschloch; wichser; hurensohn; missgeburt; dreckschwein; drecksau; vollidiot; scheißkerl; fotze; untermensch; kanake; nigger; stück scheiße; arschgesicht; flachwichser; schwuchtel; judensau; scheißhaufen; dreckshure
        de x: arschlöcher; hurensöhne
        ru n: мудак; мудил; ублюдок; ублюдк; сук; долбоёб; пидор; пидорас; гандон; сволоч; говнюк; хуесос; жид; чурк; выродок; выродк; недоумок; недоумк; мудозвон; пиздабол; уёбок; уёбк; ёбан; кусок говна; кусок дерьма; ебанут; блядин; мудоёб; долбоящер
        ru x: сука; суки; сволочь; сволочи; блядь; сукин сын; тупая скотина; педик; черножопый; черножопые
        es n: hijo de puta; hija de puta; gilipollas; maricón; malparid; pendej; hijueput; mamón; sudaca
        es x: hijos de puta; cabrón; cabrones; maricones
        it n: stronz; figlio di puttana; coglion; testa di cazzo; pezzo di merda; froci; rottinculo; merdos
        it x: figli di puttana; teste di cazzo
        zh x: 傻逼; 傻屄; 傻比; 傻b; 王八蛋; 狗杂种; 杂种; 狗娘养; 婊子; 贱货; 狗日的; 操你妈; 草泥马; 肏你; 妈逼; 臭婊子; 贱婢; 狗屎东西; 死全家; 妈的; 你他妈; 他妈的; 日你; 滚你妈; 龟孙子; 小婊砸; 黑鬼; 死肥猪; 支那; 臭傻; 狗崽子; 兔崽子; 死娘炮
    """,
    # turns before an insult that make an attack of it
    "SUCH": """
        en x: what a; what an; what kind of; such a; such an; a bunch of; bunch of; a pack of; pack of; a gang of; gang of; a bag of; only a; only an; which; what an absolute; what a total; herd of; swarm of; gaggle of; nest of
        fr x: quel; quelle; quels; quelles; espèce de; espèce d'; bande de; bande d'; ramassis de; n'es qu'un; n'es qu'une; n'est qu'un; n'est qu'une; n'êtes que des; n'êtes qu'; tous des; seul un; meute de; troupeau de; bande d'
        de x: so ein; so eine; was für ein; was für eine; was für; nur ein; nur eine; nichts als; ein haufen; du elender; du elende; bande von; welcher; horde; rudel; meute; lauter; bist du nur für eine; bist du für ein
        ru x: какой же; какая же; какой; какая; какие; такой; такая; сборище; банда; кучка; стая; только; стадо; свора; шайка; что за; ну и
        es x: qué; menudo; panda de; banda de; pedazo de; montón de
        it x: che; banda di; branco di; razza di; pezzo di; solo un; solo una
        zh x: 只有; 这种; 就是个; 全是; 简直是; 一群; 这群; 真是个; 一帮; 一窝; 一伙; 纯粹是; 十足的; 一个比一个
    """,
    # orders to be silent, to go away and the like: an attack beside an insult
    "DISMISS": """
        en x: get lost; shut up; shut it; stop posting; crawl back; lick their boots; lick the boots; go home; go away; go back to; get out of here; piss off; bugger off; screw off; stuff it; get a life; back to your hole; back to your cave; your drivel; beat it; get stuffed; sod off; drop it; buzz off; take a hike; shut your mouth; shut your trap; learn to read
        fr x: dégage; dégagez; ferme-la; tais-toi; taisez-vous; casse-toi; barre-toi; la ferme; va mourir; fous le camp; foutez le camp; ta bouche; ferme-la; fermez-la
        de x: halt die klappe; halt den mund; halt endlich den mund; haut ab; hau ab; verschwinde; verzieh dich; geh heim; geh sterben; zieh leine; lern erst mal; verschwindet
        ru x: заткнись; заткнитесь; закройся; убирайся; убирайтесь; пошёл вон; пошла вон; пошли вон; вали отсюда; проваливай; молчать; закрой свой рот; рот закрой; завали; помолчи; иди отсюда; вон отсюда
        es x: cállate; lárgate; vete a la; fuera de aquí
        it x: stai zitto; sparisci; vattene; chiudi la bocca
        zh x: 闭嘴; 滚; 滚开; 滚远点; 一边去; 别在这里; 丢人; 没一个好东西; 替他们说话; 放屁; 骂你; 也配; 闭上你的; 臭嘴; 滚回家; 闭上嘴; 少放屁; 滚吧
    """,
    # idioms that degrade by themselves
    "IDIOM": """
        en x: go fuck yourself; fuck you; f you; fuck off; eat shit; kiss my ass; go to hell; burn in hell; rot in hell; you disgust me; you make me sick; screw you and; waste of oxygen; shove it up your; up yours; blow it out your; suck my dick; lick my ass; fuck your mother; thick as two short planks; shut your mouth; shut your face; shut your trap; go choke on
        fr x: ferme ta gueule; fermez vos gueules; ta gueule; nique ta mère; va te faire foutre; va te faire enculer; allez vous faire foutre; vous me dégoûtez; tu me dégoûtes; va chier; va te faire voir; bête à manger du foin; je t'emmerde; je vous emmerde; con comme un balai; ferme ta bouche
        de x: halt die fresse; halt dein maul; halt's maul; fick dich; verpiss dich; leck mich am arsch; du kotzt mich an; ihr kotzt mich an; fahr zur hölle; halt die schnauze; fickt euch; verpisst euch; gehörst weggesperrt; ins hirn geschissen; dumm wie brot; nicht alle tassen
        ru x: заткни пасть; пошёл ты; пошла ты; пошли вы; иди на хуй; иди нахуй; нахуй иди; пошёл нахуй; иди в жопу; пошёл в жопу; закрой пасть; закрой рот; ты мне противен; меня от тебя тошнит; ёб твою мать; отъебись; иди к чёрту; катись к чёрту; дуб дубом; без мозгов
        es x: vete a la mierda; que te jodan; jódete; vete al infierno; chinga tu madre; come mierda; me das asco; tu puta madre
        it x: vaffanculo; va' a cagare; vai a cagare; fottiti; vai all'inferno; mi fai schifo; va a farti fottere
        zh x: 去吃屎; 吃屎吧; 吃屎去; 回去吃屎; 脑子被驴踢; 脑子进水; 脑子都进水; 脑子有病; 脑子被门夹; 你有病吧; 有病吧; 你妈死了; 不要脸的东西; 你算什么东西; 狗都不如; 猪狗不如; 禽兽不如; 没爹妈教; 生块叉烧; 生你不如; 骗子东西; 滚出去吧; 去你妈; 去你大爷; 看见你就恶心; 丧尽天良; 臭不要脸; 下地狱; 断子绝孙; 脑子里全是; 脑子里装的; 脑袋被; 一肚子坏水
    """,
    "FLATTER": """
        en x: compliment; flattery; flattering; too kind; would be an insult to
        fr x: compliment; flatteur; trop gentil
        de x: kompliment; geschmeichelt; schmeichelei
        ru x: комплимент; похвала; льстить
        zh x: 抬举; 夸奖; 侮辱了狗; 侮辱了猪; 便宜你
    """,
    "DESPISE": """
        en x: despise; despises; ashamed of; hate; hates; loathe; loathes; should have drowned; should have aborted; should have swallowed; at birth
        fr x: méprise; méprisent; a honte de; ont honte de; déteste; détestent
        de x: verachtet; verachten; schämt sich für; schämen sich für; hasst; hassen
        ru x: презирает; презирают; стыдится; стыдятся; ненавидит; ненавидят
        zh x: 瞧不起; 看不起; 以你为耻; 嫌弃
    """,
    # -- harm ------------------------------------------------------------------
    # kills or maims whoever is its object
    "KILL": """
        en v: kill; murder; stab; strangle; cripple; lynch; behead; maim; slaughter; rape; gut; torture; throttle; skin alive; disembowel; castrate; bury
        fr v: tu; égorg; étrangl; massacr; tabass; but; défonc; flingu; crev; dézingu; lynch; poignard; zigouill; viol
        de x: töten; töte; umbringen; umbringe; erschießen; erschieße; erstechen; ersteche; abstechen; erschlagen; erschlage; verprügeln; verprügle; erwürgen; erwürge; totschlagen; abknallen; abschlachten; aufschlitzen; vergewaltigen; lynchen; abfackeln; kaltmachen; abmurksen; umlegen; plattmachen; kastrieren
        ru x: убить; убивать; зарезать; прирезать; задушить; застрелить; придушить; искалечить; расстрелять; расстреливать; замочить; прибить; порвать; вешать; повесить; утопить; растерзать; прикончить; линчевать; удавить; пристрелить; зарубить; забить
        es x: matar; matarte; matarlo; asesinar; degollar; estrangular; apuñalar; violar; reventarte; rajarte
        it x: ammazzare; ammazzarti; uccidere; ucciderti; sgozzare; strangolare; accoltellare; stuprare
        zh x: 弄死; 砍死; 捅死; 打死; 杀了; 杀掉; 宰了; 干掉; 掐死; 勒死; 烧死; 撞死; 砍了; 捅了; 剁了; 打残; 弄残; 剁碎; 打断; 打爆; 揍死; 打烂; 废了; 做掉; 揍; 砍; 捅; 剁; 宰; 整死; 活埋; 强奸; 灭了
    """,
    # first person of such verbs, in languages that leave the pronoun out
    "IKILL": """
        ru x: убью; убьём; зарежу; зарежем; прирежу; прирежем; задушу; задушим; изобью; изобьём; покалечу; покалечим; застрелю; застрелим; придушу; придушим; искалечу; прибью; прибьём; прикончу; прикончим; подкараулю; урою; уроем; вырежу; вырежем; грохну
        es x: mataré; mataremos; reventaré
        it x: ammazzo; uccido; ammazziamo; sgozzo; strozzo; ucciderò; ammazzerò
    """,
    "IHURT": """
        ru x: переломаю; переломаем; сломаю; сломаем; оторву; оторвём; разобью; разобьём; сожгу; сожжём; закопаю; закопаем; порву; порвём; набью; набьём; выбью; выбьем; подожгу; подожжём; взорву; взорвём; утоплю; утопим; повешу; повесим; отрежу; расшибу; замочу; замочим; вырву; вырвем; выколю; выколем; откушу; проломлю; проломим; размажу; размажем; расшибу; свернём; сверну; выпотрошу; раздавлю; раздавим; выбью
        es x: romperé; partiré; quemaré; quemaremos
        it x: spacco; spezzo; brucio; bruceremo; spaccherò
    """,
    # hurts a person only with a part of the body, a home, or a clear end
    "HURT": """
        en v: beat; burn; break; smash; crush; punch; choke; shoot; hang; drown; bury; cut; slit; snap; slice; kick; hit; torch; destroy; hurt; knock; crack; rip; blow up; burn down; cave; slap; poison; finish
        en x: 
        fr v: cass; bris; frapp; brûl; coup; tranch; écras; explos; pét; cogn; arrach; incendi; arrach; égratign; fracass
        fr x: rompre; pendre; faire la peau; fera la peau; battre
        de x: breche; brechen; brech; schlage; schlag; schlagen; haue; hauen; verbrennen; zünde; zünden; abbrennen; schneide; schneiden; aufhängen; zertrümmern; polieren; einschlagen; ersäufen; verprügeln; zusammenschlagen; schieße; stech; steche; stechen
        ru x: сломать; переломать; разбить; сжечь; оторвать; закопать; набить; избить; бить; отрезать; взорвать; давить; резать; перерезать; поджечь; проломить
        es x: romper; romperte; partir; partirte; quemar; quemarte; golpear; pegar un tiro; cortar; cortarte
        it x: rompere; spaccare; spaccarti; bruciare; tagliare; tagliarti; picchiare; spezzare; sparare
        zh x: 敲断; 割断; 拧断; 打断; 打烂; 烧了; 砸烂; 割断; 炸了; 砸断; 剥了; 踩烂; 卸了; 拧下
    """,
    # passive of either: what should be done to somebody
    "SLAIN": """
        en x: killed; murdered; shot; hanged; hung; strung up; gassed; executed; lynched; drowned; beheaded; burned alive; burnt alive; exterminated; slaughtered; stabbed; wiped out; put down; put to death; castrated; tortured; beaten to death; raped; put against the wall; eradicated; run over; flogged; crucified; aborted; impaled; torn apart; euthanized; sterilized; fumigated; disinfected; euthanised; put to sleep; string up; sterilised; gassed; neutered
        fr x: tués; tuer; pendus; pendu; fusillés; fusillé; fusiller; gazés; gazer; exterminés; exterminer; exécutés; noyés; égorgés; abattus comme; éliminés; brûlés vifs; lyncher; pendre; castrer; éradiquer; stériliser; pende; pendent; fusille; fusillent; crève; abatte; brûle; noie; enferme
        de x: erschossen; erschießen; erhängt; aufgehängt; aufhängen; vergast; vergasen; ausgerottet; ausrotten; hingerichtet; totgeschlagen; abgeknallt; abgestochen; erschlagen; an die wand stellen; an die wand gestellt; umgebracht; umbringen; ersäufen; verbrannt; kastriert; ausgemerzt; ausmerzen; aufgeknüpft
        ru x: расстреливать; расстрелять; повесить; вешать; истребить; истреблять; уничтожить; убивать; убить; сжечь; давить; душить; травить; к стенке; стрелять; кастрировать; топить; утопить; отстреливать; газовую камеру; вырезать; усыплять; усыпить; четвертовать; линчевать
        es x: fusilar; fusilarlos; ahorcar; exterminar; exterminarlos; gasear; matarlos; colgarlos; eliminarlos
        it x: fucilare; impiccare; sterminare; gasare; ammazzarli; eliminarli; bruciarli; impiccarli
        zh x: 枪毙; 枪决; 消灭; 灭绝; 处死; 绞死; 千刀万剐; 拉出去毙了; 毙了; 打死; 杀光; 死绝; 灭种; 灭族; 吊死; 活埋; 弄死; 烧死; 凌迟; 阉了; 消灭干净
    """,
    "EXECUTE": """
        en x: lynched; lynch; gassed; hanged; castrated; beheaded; crucified; strung up; string up; sterilized
        fr x: fusiller; fusillés; gazer; gazés; lyncher; pendre; guillotiner; castrer
        de x: erschießen; erschossen; vergasen; vergast; an die wand stellen; lynchen; kastrieren; aufknüpfen
        ru x: расстрелять; расстреливать; линчевать; кастрировать; четвертовать
        es x: fusilar; fusilarlos; linchar; ahorcarlos; gasear
        it x: fucilare; fucilarli; linciare; impiccarli; gasare
        zh x: 枪毙; 凌迟; 吊死; 千刀万剐; 阉了; 毙了
    """,
    "BODY": """
        en n: face; head; skull; leg; arm; bone; neck; throat; knee; tooth; nose; jaw; finger; rib; spine; brain; house; home; car; kneecap; ass
        en x: teeth; brains out; guts; eyes; alive; to death; to a pulp; to pieces; lights out; heart out; heart; liver; throat out; tongue; bloody; senseless; unconscious; black and blue; half dead; stomach; belly; back; chest
        fr n: figure; gueule; tête; jambe; bras; os; nuque; gorge; genou; dent; nez; crâne; maison; voiture; doigt; peau
        fr x: genoux; os; yeux; la vie; cœur; langue; yeux; tripes; ventre; dos; poitrine; jambes
        de n: gesicht; fresse; kopf; schädel; bein; arm; knochen; genick; kehle; zahn; nase; kiefer; haus; auto; finger; rippe; hals; maul; hirn
        de x: zähne; köpfe; tot; bude; herz; zunge; augen; zahn aus; genick; bauch; rücken; brust; visage
        ru x: морду; морды; лицо; рожу; башку; голову; череп; ноги; ногу; руки; руку; кости; шею; горло; зубы; нос; колени; рёбра; дом; дома; машину; хребет; хату; квартиру; глаза; челюсть; пасть; язык; сердце; мозги; кишки; печень; спину; бошку; живот; сердце; лоб
        es x: cara; cabeza; piernas; brazos; huesos; cuello; garganta; dientes; nariz; casa; coche; boca; alma
        it x: faccia; testa; gambe; braccia; ossa; collo; gola; denti; naso; casa; macchina; schiena; muso
        zh x: 腿; 手; 头; 脖子; 骨头; 牙; 脸; 脑袋; 喉咙; 手脚; 狗头; 狗腿; 房子; 鼻子; 肋骨; 手指; 皮; 心脏; 肚子; 眼睛; 嘴
    """,
    "SEPVERB": """
        de x: bringe; bring; bringen; bringt; mache; mach; machen; schlage; schlag; schlagen; steche; stech; stechen; knalle; knall; hänge; häng; hängt; schlitze; fackle; murkse
    """,
    "SEPPART": """
        de x: um; kalt; tot; ab; nieder; zusammen; auf; fertig
    """,
    "MODAL": """
        en x: should; should be; ought to be; ought to; must be; must; deserve to be; deserves to be; deserve to; deserves to; deserve; deserves; need to be; needs to be; need to; needs to; have to be; has to be; have to; should all be; better be; let's; time to; can't wait to
        fr x: devrait; devraient; il faut; faut; il faudrait; faudrait; mérite; mérites; méritent; mériterait; mériteraient; doivent; doit être; qu'on; qu'ils; à quand; on devrait; on devrait tous; il faudrait tous; qu'on le; qu'on la; qu'on les; qu'on vous
        de x: sollte; sollten; gehört; gehören; müsste; müssten; muss man; müssen; sollen; muss; verdient; verdienen; man sollte; man müsste
        ru x: надо; нужно; пора; следует; должны; должен; заслуживает; заслуживают; всех; стоит
        es x: hay que; habría que; deberían; debería; merecen; merece; que los; tienen que
        it x: bisogna; andrebbero; dovrebbero; dovrebbe; meritano; merita; vanno; va; bisognerebbe
        zh x: 应该; 就该; 该; 必须; 得; 都该; 早该; 统统; 全部; 一律; 应当; 活该; 应; 全都
    """,
    "DIE": """
        en x: drop dead; croak; choke to death; bleed; bleed out; get cancer; burn in hell; get run over; cancer; get hit by a; to die; and die; should die; all die; will die; must die; you die; they die; he dies; she dies; just die; gonna die; would die; would all die; deserve to die; die slowly; die in; die tonight; die alone; dies in; were dead; was dead; rot in; die of; burns; burn; burns down; gets cancer; get hit; gets hit; get raped; starve; starves; chokes
        fr x: crever; crève; creviez; crèves; mourir; meures; mourez; crevez; mouriez; un cancer; le cancer; pourrir; crèvent; meurent
        de x: verreckst; verrecken; verreckt; sterben; stirbst; krepieren; krepierst; krepiert; krebs; draufgehst; abkratzt; verrecke; sterbt
        ru x: сдох; сдохли; сдохнуть; сдохнешь; сдохнете; сдохнут; умер; умрёшь; умрёте; умри; умрите; подохнешь; подохли; подыхать; рак; сдохла; издох
        es x: morirte; mueras; muráis; mueran; morirás; vas a morir; morir; cáncer; revientes
        it x: morire; muori; morirai; crepare; crepi; crepiate; muoia; schiattare
        zh x: 死; 死掉; 死光; 撞死; 暴毙; 不得好死; 死全家; 得癌症; 出门被车撞; 被车撞死; 死于非命; 早死
    """,
    "FUT": """
        en x: will; 'll; going to; gonna; are going to; shall
        fr x: vas; allez; va; vont
        de x: wirst; werdet; wird
        ru x: скоро; ещё
        es x: vas a; vais a; va a
        it x: stai per; state per
    """,
    "WISH": """
        en x: hope; hoping; wish; wishing; pray; can't wait for; looking forward to; wishing you
        fr x: j'espère; espère; souhaite; vivement que; puisses-tu; puissiez
        de x: hoffe; hoffentlich; wünsche; mögest
        ru x: чтоб; чтобы; надеюсь; желаю; хоть бы; пусть
        es x: ojalá; espero que
        it x: spero che; spero; che tu
        zh x: 祝; 希望; 巴不得; 诅咒; 但愿; 愿
    """,
    # complete threats
    "MENACE": """
        en x: watch your back; you are dead; you're dead; dead meat; your days are numbered; sleep with one eye open; won't see tomorrow; won't leave alive; you bleed; you will bleed; you'll bleed; you will pay with your life; i'll end you; i will end you; go die; coming for your kids; coming for your family; don't make it home; never walk again; won't live to see; not live to see; will regret being born; dead man; dead woman; dead men; will pay for this with; make you pay; get what is coming; wipe you out; count your days; say goodbye to your; pay for this
        fr x: crève; crevez; surveille tes arrières; tes jours sont comptés; je vais te faire la peau; compte tes abattis; tu es mort; t'es mort; tu vas le payer de ta vie; tu ne passeras pas; vous êtes morts; tu vas le regretter; vous allez le regretter; fais ta prière; dis adieu à
        de x: verrecke; verreckt; du bist tot; ihr seid tot; deine tage sind gezählt; dreh dich lieber um; wirst du nicht überleben; erlebst du nicht; wirst du bereuen; wirst du büßen; kommst hier nicht lebend; kriegen wir noch; kommst nicht davon; wird dich erwischen; mach dein testament
        ru x: сдохни; сдохните; тебе не жить; вам не жить; тебе конец; вам конец; ходи и оглядывайся; убейся; тебе хана; жить не будешь; ты труп; вы трупы; гореть вам в аду; гореть тебе в аду; гори в аду; не доживёшь; не доживёте; пожалеешь; пожалеете; прощайся с; молись; тебе крышка; считай дни
        es x: muérete; estás muerto; te vas a enterar; tus días están contados
        it x: crepa; sei morto; sei un uomo morto; hai i giorni contati
        zh x: 去死; 去死吧; 快去死; 去死啊; 你死定了; 要你的命; 要你命; 取你狗命; 收尸; 见一次打一次; 见你一次打; 让你消失; 放你的血; 让你躺着; 躺着出; 让你见不到; 你活不; 不得好死; 等死吧; 血债血偿; 小命; 带刀去; 拿刀去; 带着刀; 去4; 去 4; 不得安宁; 鸡犬不宁; 生不如死; 别想活; 活着离开; 活不过; 死在我手; 见阎王; 砸了你家; 放火烧你
    """,
    "SHAME": """
        en x: a shame if; shame if; pity if; unfortunate if
        fr x: dommage si; dommage qu'
        de x: schade wenn; schade, wenn
        ru x: жаль если; жаль, если; будет жаль
        zh x: 可惜了; 出点事; 出意外
    """,
    # calls to suicide
    "SUICIDE": """
        en x: hang yourself; kill yourself; kill yourselves; jump off the roof; jump off a roof; jump off a bridge; jump off the bridge; jump off a cliff; jump out of the window; jump in front of; throw yourself under; throw yourself off; slit your wrists; end your life; drink bleach; neck yourself; kys; drown yourself; shoot yourself; go hang yourself
        fr x: pends-toi; pendez-vous; suicide-toi; suicidez-vous; saute du toit; saute par la fenêtre; saute d'un pont; te jeter sous; vous jeter sous; te pendre; vous pendre; te foutre en l'air; jette-toi; te tuer toi-même; ouvre-toi les veines
        de x: häng dich auf; hängt euch auf; erhäng dich; spring vom dach; spring von der brücke; spring aus dem fenster; bring dich um; bringt euch um; wirf dich vor; schmeiß dich vor; nimm dir das leben; schneid dir die pulsadern; bring dich doch
        ru x: повесься; повесьтесь; удавись; удавитесь; убей себя; прыгни с; спрыгни с; выпрыгни; прыгни под; выпей яду; утопись; застрелись; иди повесься; иди и повесься; сдохни сам; вскрой вены
        es x: suicídate; mátate; ahórcate; tírate por; tírate de; cuélgate; pégate un tiro
        it x: ammazzati; suicidati; impiccati; buttati; sparati; tagliati le vene
    """,
    "LEAP": """
        en x: jump; leap; throw yourself; step in front
        fr x: saute; sautez; jette-toi; jetez-vous; te jeter; vous jeter
        de x: spring; springt; stürz dich; wirf dich; schmeiß dich
        ru x: прыгни; спрыгни; выпрыгни; бросься; сигани
        es x: tírate; salta
        it x: buttati; salta
    """,
    "HEIGHT": """
        en x: roof; bridge; cliff; window; train; balcony; truck; building; bus
        fr x: toit; pont; falaise; fenêtre; train; balcon
        de x: dach; brücke; klippe; fenster; zug; balkon; hochhaus
        ru x: крыши; моста; окна; поезд; балкона; обрыва
        es x: tejado; puente; ventana; tren; balcón
        it x: tetto; ponte; finestra; treno; balcone
    """,
    "SUIVERB": """
        zh x: 上吊; 跳楼; 从楼上跳; 跳河; 自杀; 割腕; 喝农药; 跳海; 撞墙; 自尽; 自我了断; 抹脖子; 跳崖; 卧轨; 跳江; 去死
    """,
    "HURRY": """
        zh x: 早点; 赶紧; 快去; 去; 还不; 怎么还不; 怎么不; 快点; 不如; 趁早; 劝你
    """,
    "KNOW": """
        en x: know where; knows where; know when; find out where; found out where; know which; know exactly where
        fr x: sais où; sait où; savons où; connais ton adresse; trouver où
        de x: weiß wo; weiß, wo; wissen wo; wissen, wo; weiß genau, wo; wissen genau, wo; kennen deine adresse
        ru x: знаю где; знаю, где; знаем где; знаем, где; узнаю, где; знаю твой адрес; знаем твой адрес; узнаем, где
        es x: sé dónde; sabemos dónde
        it x: so dove; sappiamo dove
        zh x: 知道你; 知道他; 知道她; 知道他们; 查到你; 知道你们; 清楚你
    """,
    "LIVE": """
        en x: live; lives; sleep; sleeps; work; works; park; go to school; goes to school; school; school; bus; address; street; route
        fr x: habites; habitez; habite; vis; vivez; travailles; travaillez; école; dors; l'école; bureau; rue; travail
        de x: wohnst; wohnt; lebst; arbeitest; arbeitet; schule; schläfst; kindergarten
        ru x: живёшь; живете; живёте; живёт; работаешь; работаете; учится; учатся; школу; школа; ночуешь
        es x: vives; vivís; viven; trabajas; colegio; escuela
        it x: abiti; abitate; vivi; lavori; scuola
        zh x: 住哪; 家住; 住; 上学; 上班; 在哪; 学校; 公司在; 住址; 地址
    """,
    "HUNT": """
        en x: find; finds; waiting at; be waiting; waiting for; wait for; get you; track down; hunt
        fr x: retrouver; retrouverai; retrouvera; attendrai; attendra; attendre à la sortie; attendrons
        de x: finde; finden; warte; erwische; kriege; kriegen
        ru x: буду ждать; найду; найдём; встретим; встречу
        es x: encontraré; encontraremos; esperaré
        it x: troverò; troveremo; aspetto; aspettiamo
        zh x: 找到; 等着; 盯上
    """,
    "STALK": """
        en x: hunt down; hunting; coming for; come for; coming after; come after; going to get; hunt
        fr x: ferai la peau; aurai la peau
        de x: lauere; lauern; jagen; holen uns; kriegen dich; krieg dich; kommen zu; holen wir; holen uns; kommen wir
        ru x: подкараулю; подкараулим; достану; достанем; придём за; приду за; придём к; доберёмся до; доберусь до
        es x: iré a por; iremos a por; voy a por; vamos a por
        it x: vengo a prendere; veniamo a prendere
        zh x: 堵; 找上门; 堵住
    """,
    "WEAPON": """
        en n: knife; gun; hammer; bat; axe; bullet; machete; rifle; pistol; bomb; rope; crowbar; shotgun; grenade; blade; club
        en x: knives; petrol; gasoline; acid; baseball bat; explode; explodes; exploded; caught fire; burned down; blew up; had an accident
        fr n: couteau; marteau; flingue; fusil; hache; batte; pistolet; bombe; corde; essence; acide
        de n: messer; hammer; axt; pistole; gewehr; knarre; bombe; strick; schläger; benzin; säure
        ru x: ножом; молотком; топором; пистолетом; битой; ружьём; верёвкой; бомбу; нож; с битой; бензином; кислотой
        es x: cuchillo; martillo; pistola; hacha; bate; navaja
        it x: coltello; martello; pistola; ascia; mazza; benzina
        zh x: 刀; 枪; 锤子; 斧头; 棍子; 汽油; 炸弹; 铁棍; 硫酸; 砖头
    """,
    "BULLET": """
        en x: bullet; a bullet; slug
        fr x: balle; une balle
        de x: kugel; eine kugel
        ru x: пулю; пуля
        es x: bala; una bala
        it x: pallottola; una pallottola; proiettile
        zh x: 子弹; 一枪
    """,
    "BEWARE": """
        en x: watch out; better watch out; be careful; beware; you better; if i see you; see you again; show up; count on it; dare
        fr x: fais gaffe; fais attention; attention à toi; gare à toi; si tu reviens; si je te revois
        de x: pass auf; passt auf; nimm dich in acht; wehe; wenn ich dich
        ru x: берегись; берегитесь; смотри у меня; готовься; приедешь; попадёшься; ещё раз
        es x: ten cuidado; cuidado; como te vea
        it x: stai attento; attento; se ti vedo
        zh x: 小心点; 小心; 等着吧; 等着; 走着瞧; 给我等; 再敢; 敢来; 别让我
    """,
    # -- hatred ----------------------------------------------------------------
    "DEHUM": """
        en x: subhuman; subhumans; sub-human; breed like; multiply like; like rats; like cockroaches; like vermin; no soul; not deserve to live; don't deserve to live; doesn't deserve to live; no right to live; a plague; a disease; diseases; a cancer; not human; not even human; aren't human; are not people; inferior race; inferior; genetically stupid; in a coffin; in a cage; in cages; in the sewer; belong in the kitchen; belong in a zoo; in camps; in ovens; a stain on; crawled out; outbreed; rob us; steal our; infest; infesting; infestation; swarm; thieves by nature; criminals by nature; born liars; born thieves; born criminals; too stupid; too dumb; animals in clothes; human garbage; ruin everything; second class; lower than animals; all rapists; all criminals; all terrorists; are rapists; are terrorists; human garbage; human trash; human waste; waste of space; waste of oxygen; waste of air; leeches; biological waste; a virus; a blight; a pestilence; scum of the earth; a burden on; useless eaters; rapists; invaders; vermin; subhuman vermin
        fr x: sous-hommes; sous-race; race inférieure; pas de vivre; pas d'âme; une plaie; un cancer; racaille; de la merde; se reproduisent comme; trop connes; trop bêtes; trop stupides; pas des humains; pas humains; voleurs de nature; tous des voleurs; nous envahissent; droit de vivre; maladie; bouches inutiles; un fléau; une maladie; des envahisseurs; la lie
        de x: untermenschen; kein recht zu leben; nicht zu leben; eine plage; eine seuche; minderwertig; minderwertige; vermehren sich wie; zu blöd; zu dumm; keine menschen; sind tiere; geborene verbrecher; geborene diebe; der letzte dreck; überschwemmen uns; gesindel; pack; gehören raus; lebensunwert; krebsgeschwür; unnütze esser; abschaum; eine last; ein geschwür; lebensunwertes leben; eine krankheit; invasoren
        ru x: нелюди; недолюди; сброд; не люди; не человек; не заслуживают жить; недостойны жить; зараза; низшая раса; второй сорт; как крысы; как тараканы; воры от рождения; слишком тупы; слишком глупы; плодятся; чума; раковая опухоль; унтерменши; недочеловеки; обуза; болезнь; биомусор; саранча; плесень; недолюди; нахлебники; лишние рты
        es x: raza inferior; no son humanos; no son personas; una plaga; un cáncer; no merecen vivir; demasiado tontas; nos invaden; subhumanos
        it x: razza inferiore; non sono umani; non sono persone; una piaga; un cancro; non meritano di vivere; troppo stupide; ci invadono; subumani
        zh x: 劣等人; 劣等民族; 劣等种; 劣等; 不配活; 不配做人; 不配; 骨子里就脏; 骨子里脏; 骨子里; 不是人; 跟畜生没两样; 畜生没两样; 没两样; 低等; 下等人; 贱种; 没人性; 天生就是; 天生的贼; 天生低贱; 老鼠屎; 传染病; 病毒; 瘟疫; 祸害; 社会毒瘤; 繁殖; 蝗虫; 全是贼; 都是贼; 全是小偷; 都是小偷; 浪费粮食; 浪费空气; 浪费资源; 累赘; 毒瘤; 污染; 祸水; 垃圾人种
    """,
    "EXPEL": """
        en x: get rid of; driven out; drive them out; drive out; throw out; throw them out; kick out; kick them out; thrown out; kicked out; keep out; get them out; deport them all; deport all; deport every; lock them up; locked up; lock up all; lock up every; burn it down; round up; round them up; fumigate; disinfect; gas them; gas the; hose it down; exterminate; wipe out; purge; cleanse; eradicate; never hire; don't hire; do not hire; no entry for; ship them back; send back; go back where; out of our country; out of this country; every last one; flush out; gas chamber; gas chambers; to the gas; kick them all out; throw them all out; bomb them; nuke them; out of here; out of my country; out of town; go back home; back to where; back to the jungle
        fr x: qu'on les chasse; chassez; chasser tous; tous dehors; foutez-les; virez-les; renvoyez-les; qu'ils dégagent; dégagez; qu'on les vire; tous les expulser; expulsez-les; expulser tous; qu'on les enferme; n'embauchez jamais; dehors les; les foutre dehors; nettoyer; les enfermer tous; exterminer; dehors; à la mer; aux fours; hors de france; raus; rentrez chez vous; rentrez chez eux; retournez chez vous; retourne chez toi
        de x: müssen alle weg; alle weg; raus mit; müssen raus; raus aus; gehören raus; alle abschieben; alle ausweisen; alle eingesperrt; wegsperren; alle einsperren; nie einstellen; schmeißt sie raus; verjagen; muss man loswerden; rausschmeißen; rauswerfen; raus; ausrotten; vergasen; vergast; weggesperrt; gehören weg; gehört weg; weg mit; alle raus; ins gas; rauswerfen
        ru x: гнать их; гнать всех; гнать; гоните; вон отсюда; выгнать; выслать всех; всех отсюда; всех посадить; надо посадить; убирайтесь; пусть убираются; понаехали; запереть; депортировать всех; никогда не берите; не берите на работу; выселить; вышвырнуть; очистить; давить; истребить; пересажать; в печь; в газовую; чемодан вокзал; гнать в шею; вышвырнуть; прогнать; усыплять; валите домой; валите отсюда; домой; вон из страны; вон из
        es x: hay que echarlos; echarlos a todos; fuera de nuestro; que se vayan; exterminar; expulsarlos a todos; echadlos; fuera; a su país; largo de aquí
        it x: cacciateli; cacciarli; fuori dall'italia; mandateli via; sterminare; rimandateli; fuori dai piedi; via tutti; buttateli fuori; a casa loro; a casa vostra
        zh x: 赶出去; 赶出; 赶走; 滚出; 滚回; 回老窝; 不许进门; 不准进; 一律不许; 见一个赶一个; 见一个打一个; 关起来; 别招; 不要招; 清除出去; 抓起来; 轰出去; 驱逐; 药熏; 熏一遍; 消灭; 灭种; 灭绝; 死绝; 清洗掉; 赶尽杀绝; 杀光; 都滚; 滚出去; 滚回去; 全部滚; 滚回农村; 滚蛋; 回老家
    """,
    "STENCH": """
        en x: fumigate; disinfect; hose it down; burn it down; what a smell; what a stench; stink; stinks; smell; delouse
        fr x: ça pue; quelle odeur; désinfecter; brûlez-la
        de x: stinkt; was für ein gestank; ausräuchern; desinfizieren; abbrennen
        ru x: воняет; какая вонь; продезинфицировать; выжечь
        zh x: 药熏; 熏一遍; 消毒; 臭死; 恶臭; 真臭
    """,
    "FULL": """
        en x: full of; nothing but; infested with; crawling with; overrun by; overrun with
        fr x: pleine de; plein de; infesté de; infestée de
        de x: voller; voll von; verseucht mit; überrannt von
        ru x: полно; полон; полная; кишит
        zh x: 混进了; 混进; 全是; 满是; 到处是
    """,
    "ONLYGOOD": """
        en x: only good thing; only good; the only thing good
        fr x: la seule bonne chose; le seul bon; un bon
        de x: das einzig gute; nur ein toter; der einzig gute
        ru x: единственное хорошее; хороший
        zh x: 唯一的好处; 只有死了的
    """,
    "GRAVE": """
        en x: coffin; dead one; dead; a dead; grave; graveyard; six feet under; cemetery
        fr x: cercueil; mort; tombe; cimetière; morte
        de x: sarg; tot; toter; grab; friedhof
        ru x: гробу; гроб; мёртвый; могила; могиле
        zh x: 棺材; 死了; 坟; 墓
    """,
    # -- sex -------------------------------------------------------------------
    # explicit wherever it stands
    "EXPLICIT": """
        en n: blowjob; blow job; handjob; gangbang; creampie; cumshot; threesome; milf; footjob; rimjob; dick pic; sex tape
        en x: send me nudes; send nudes; deepthroat; hardcore sex; hardcore porn; free porn; xxx; sex cam; nude cam; naked cam; sex chat; anal sex; suck my dick; suck my cock; wet pussy; sex videos; sex video; porn videos; porn video; give oral; gives oral; begging for it; want to fuck; wants to fuck; wanna fuck; fuck me; fuck all night; fuck tonight; cum on; cum in; live sex; doggy style; sixty-nine; jerk off; jerking off; horny; spread their legs; spread her legs; spread your legs; jerk you off
        fr x: baisent; baisée; baisées; baiser toute; envie de baiser; te baiser; te sucer; suce-moi; plan cul; vidéos porno; vidéo porno; porno gratuit; partouze; sexe en direct; gros seins; nichons; salopes en chaleur; branlette; fellation; sodomie; faire jouir; sucent des bites; mouille pour
        de x: ficken; fickt; fickte; durchficken; gefickt; fick mich; geile titten; dicke titten; live-sex; sexvideos; pornos; nacktbilder; blasen lassen; gangbang; wichsen; bumsen; abspritzen; arschfick; fickst; vögeln; gevögelt
        ru n: трах; шлюх порно
        ru x: трахал; трахала; трахаются; трахаться; трахнуть; трахать; трахает; трахни; выебу; ебутся; ебать; порно видео; порно бесплатно; отсосу; отсоси; минет; сиськи; интим услуги; раздвинь ноги; кончила; дрочить; дрочит; секс видео; оральный секс
        es x: follar; follarte; follando; mamada; chupármela; pajearse; porno gratis; tetas; correrse en; coger contigo; polla
        it x: scopare; scoparti; scopata; pompino; sega; porno gratis; fica; figa; tette; cazzo duro; venire in bocca
        zh x: 做爱; 约炮; 裸聊; 黄片; 自摸; 口活; 陪睡; 求操; 操我; 操死; 脱衣陪; 骚货; 裸照; 成人视频; 激情视频; 包夜; 援交; 色情直播; 轮奸; 打飞机; 撸一管; 口交; 肛交; 内射; 舔遍; 骑在我身上; 床上功夫; 叫床; 潮吹; 干一整夜; 干了她; 干了一整夜; 啪啪啪; 性爱视频; 全裸直播; 美女裸体; 吃鸡巴; 爆菊; 无码; 大尺度; 扒光
    """,
    "ACT": """
        en v: suck; lick; fuck; screw; bang; undress; strip; spread; grope; fondle; moan; ride; fondle; penetrate; thrust; caress; finger; hump; bend
        en x: bend over; bent over; on her knees; on his knees; top off; her legs; their legs; doing it; in every position; all night; rip your clothes; clothes off; want your; want my; look at those; inside me; inside you; inside her; from behind; grabbed her; touching herself; touches herself; action; thrust into; thrusting; moaned; rode him; spread for
        fr v: suc; léch; bais; caress; branl; pelot; enfil; déshabill
        fr x: écarte les jambes; à quatre pattes; toute la nuit; se déshabillent; se déshabille; se touchent; se touche; gémit; gémissent
        de x: lecken; leck; lutschen; lutsch; blasen; reiten; ausziehen; zieh dich aus; befummeln; begrapschen; spreizen; spreiz; die ganze nacht; zeigen ihre; zeigt ihre; verwöhnen; verwöhnt; ziehen sich aus; zieht sich aus; stöhnt; stöhnen; spreizte; spreizt die beine; stöhnte; ritt; rittlings
        ru x: сосать; сосут; соси; сосёт; лизать; вылизать; лижет; раздеть; раздену; раздвинь; кончить; мастурбирует; лапать; всю ночь; стонала; стонет; раздевается; раздеваются; показывает; стонет; ласкает; ласкают
        es x: chupar; chuparte; chúpame; lamer; lamerte; tocarte; desnudarte; toda la noche; montarte
        it x: leccare; leccarti; succhiare; succhiarti; spogliarti; toccarti; tutta la notte; montarti
        zh x: 舔; 揉; 摸; 操; 干; 脱光; 骑; 吻遍; 插; 抽插; 张开; 揉一把; 发片; 上门; 私信; 直播; 在线; 一整夜; 随叫随到; 来我房间; 想看; 呻吟; 难耐; 包你爽; 爽翻; 高潮; 欲火; 勾引
    """,
    "LUST": """
        en v: suck; lick; fuck; undress; grope; fondle
        fr v: suc; léch; pelot; déshabill; caress
        de x: lecken; leck; lutschen; befummeln; begrapschen; ausziehen; in den mund; in deinen mund; leckte; leckt; lutschte; lutscht; fingerte; besorgte es; besorgt es
        ru x: вылизать; лизать; облизать; раздеть; раздену; лапать; отлижу; оближу; в рот; сосала; сосёт; лизал; лижет; лизала; отсосала; вставил; засунул
        es x: chupar; chuparte; lamerte; desnudarte
        it x: leccarti; leccare; succhiarti; spogliarti
        zh x: 舔; 扒光; 操; 揉; 揉一把
        en x: in your mouth; in my mouth; down your throat; sucked; licked; fucked; fondled; groped; gets fucked; got fucked; fingered
        fr x: dans la bouche; suçait; léchait; pénétra; pénétrait; enfila
    """,
    "PART": """
        en n: tit; boob; ass; nipple; clit; booty; butthole; titty; penis; vagina; buttock; crotch
        fr n: seins; sein; chatte; bite; nichon; cul; téton; fesse; queue
        de n: titte; muschi; schwanz; arsch; nippel; fotze; möse; eier
        ru x: киску; киска; член; члены; члена; сиськи; сиська; жопу; попку; грудь; соски; письку; пизду; пизда; хуй; хуи; бёдра; ягодицы; попа; попы
        es x: tetas; coño; polla; culo; verga; pezones
        it x: tette; figa; fica; cazzo; culo; capezzoli
        zh x: 奶子; 屁股; 鸡巴; 阴道; 胸; 乳头; 下体; 逼; 屄; 大腿; 肉棒; 腿
        de x: ärsche; brüste; schenkel; hintern
    """,
    "ORGAN": """
        en n: tit; boob; pussy; cock; dick; clit; titty; cunt
        en x: tits; titties; boobies
        fr x: chatte; bite; bites; nichons; ta queue; seins
        de n: titte; muschi; fotze; möse
        de x: schwanz; schwänze
        ru x: киску; киска; киски; сиськи; сисек; письку; пизду; пизда; хуй; хуи; члены; члена; член
        es x: tetas; coño; polla; pezones
        it x: tette; figa; fica; cazzo; capezzoli
        zh x: 奶子; 鸡巴; 阴道; 屄; 肉棒; 下体
    """,
    "BARE": """
        en x: naked; nude; nudes; topless; horny; busty; slutty; kinky; bored; lonely; uncensored; explicit; wet; hot; teen; bodies; sexy; erotic; sensual; steamy
        fr x: nue; nues; nu; chaude; chaudes; coquine; coquines; sexy; excitée; en chaleur; brûlantes; sensuelle; torride; libertines
        de x: nackt; nackte; nackten; geil; geile; geilen; sexy; versaut; versaute; scharfe; heiße; heiss; feuchte; willige; tabulose
        ru x: голые; голая; голую; голых; горячие; возбуждённые; развратные; сексуальные
        es x: desnudas; desnuda; calientes; caliente; cachondas; cachonda
        it x: nude; nuda; calde; vogliose; arrapate; eccitata
        zh x: 裸; 裸体; 全裸; 骚; 寂寞; 性感; 成熟; 脱光; 火辣; 丝袜; 诱人; 湿; 巨乳; 爆乳
        ru a: развратн; возбуждённ; голеньк; похотлив
    """,
    "LURE": """
        en x: girls; teens; wives; housewives; divorcees; secretaries; masseuses; schoolgirls; babes; babe; chicks; join free; no signup; no card needed; full clip; webcam; on webcam; cam link; watch for free; clips; clips inside; click here; live now; in your city; escort; escorts; explicit clips; message for; porn; sex; adult video; private cam; private show; onlyfans; wet bodies; every position; hardcore; on camera; near you; singles; moms; milfs; coeds
        fr x: filles; clique ici; en direct; en webcam; webcam; ménagères; étudiantes; femmes nues; sexe; porno; escorte; gratuit; devant la caméra; étudiante; salopes; voisine
        de x: frauen; weiber; hausfrauen; mädchen; klick hier; ruf an; webcam; warten auf dich; sex; porno; kostenlos; studentinnen; vor der kamera; live vor; studentin; milfs; nachbarin; schlampen
        ru x: девушки; девки; бабы; шлюхи; жми; в прямом эфире; смотри бесплатно; бесплатно; веб-камера; секс; порно; домохозяйки; видео; домохозяйка; студентки; студентка; перед камерой; красотки; малышки; проститутки; массажистка
        es x: chicas; mujeres; webcam; en vivo; haz clic; gratis; sexo; porno; amas de casa
        it x: ragazze; donne; webcam; dal vivo; clicca qui; gratis; sesso; porno; casalinghe
        zh x: 美女; 女教练; 人妻; 少妇; 学生妹; 女优; 直播; 免费看; 点链接; 同城; 私信; 加我; 视频; 发片; 在线观看; 上门; 随叫随到; 女主持; 来我房间; 等你; 陪; 熟女; 学生; 楼凤; 小姐; 服务; 女优; 嫩模; 空姐; 护士
    """,
    # -- what changes the worth of a clause --------------------------------------
    "COP": """
        en x: is; are; am; was; were; 's; 're; 'm; be; being; looks like; look like; acts like; act like; behave like; call yourself
        fr x: est; es; êtes; sont; sommes; suis; était; étaient; c'est; ressemble à
        de x: ist; bist; seid; sind; war; waren; bin; wäre; sitzen; sieht aus wie; siehst aus wie; benimmt sich wie
        ru x: это; был; была; были; есть; —; –; такой; похож на; похожа на; ведёт себя как
        es x: es; son; sois; somos; era; está
        it x: è; sono; siamo; era; siete
        zh x: 是; 都是; 就是; 真是; 全是; 像; 真; 好; 太; 有多; 长得跟; 长得像; 活像; 是个; 就是个; 真是个
    """,
    "NEG": """
        en x: not; never; no one; nobody; isn't; aren't; ain't; wasn't; weren't; don't; doesn't; didn't; won't; wouldn't; can't; cannot; couldn't; shouldn't; mustn't; without; neither; nor; none of; no longer; hardly; far from; nothing of
        fr x: pas; jamais; aucun; aucune; nullement; personne ne; personne n'; ni; sans; guère
        de x: nicht; nie; niemals; niemand; kein; keine; keinen; keiner; keinem; keineswegs; weder; ohne; nirgends
        ru x: не; никогда; никто; нет; нельзя; ни; никак; вовсе не; отнюдь; без
        es x: no; nunca; nadie; jamás; ningún; ninguna; tampoco; sin
        it x: non; mai; nessuno; nessuna; neanche; né; senza
        zh x: 不是; 并不是; 没有; 不会; 不能; 不该; 不应; 不应该; 不要; 从没; 从来没; 从未; 没人; 没有人; 并非; 不许; 不准; 无人; 勿; 从不; 不得; 绝不; 绝非; 别; 切勿; 决不; 未曾
    """,
    # words that look like denials but are none
    "NOTNEG": """
        en x: not only; not just; nothing but; why don't you; why not; no wonder; couldn't agree more; can't you; don't you; aren't you; isn't he; no doubt; can't wait; cannot wait; won't live; not worth
        fr x: pas seulement; pourquoi pas; non seulement; sans doute; sans cervelle; n'hésite pas
        de x: nicht nur; nichts als; ohne hirn; ohne zweifel; nicht wert; wieso nicht; warum nicht; nicht mal
        ru x: не только; не просто; почему бы не; без мозгов; без сомнения; не иначе
        es x: no solo; no sólo; por qué no; sin duda; sin cerebro; nada más que
        it x: non solo; perché non; senza dubbio; senza cervello; nient'altro che
        zh x: 不但; 不仅; 不光; 怎么还不; 还不; 不算完; 难道不是; 是不是; 不就是; 毫无疑问; 不要脸
    """,
    # verbs of speech that govern what follows
    "CALL": """
        en x: call; calls; called; calling; say; says; said; saying; claim; claims; claimed; claiming; label; labels; labelled; labeled; brand; branded; describe; describes; described; describing; accuse; accuses; accused; accusing; insult; insults; insulted; insulting; threaten; threatens; threatened; threatening; shout; shouts; shouted; shouting; yell; yelled; yelling; scream; screamed; screaming; allege; alleges; alleged; denounce; denounced; portray; portrayed; portrays; depict; depicts; whisper; whispers; whispered; tell; telling; tells; incite; inciting; incited; compare; compares; compared; comparing; reading; abuse; abused; refer to; referred to; refers to; referring to; heard; deny; denies; denied
        fr x: traité; traitée; traités; traiter; traite; traitait; traitant; appelé; appeler; appelle; dit; dire; disait; dirais; dirait; qualifié; qualifier; accusé; accuser; menacé; menacer; menace; menaçait; insulté; insulter; crié; criait; affirmé; affirme; prétend; prétendre; décrit; décrire; comparé; comparer; lancé; hurlé; répète
        de x: genannt; nennen; nannte; nennt; bezeichnen; bezeichnet; bezeichnete; beschimpft; beschimpfen; beschimpfte; sagte; sagt; sagen; gesagt; behauptet; behaupten; behauptete; drohte; droht; gedroht; drohen; bedroht; bedrohte; rief; schrie; beleidigt; beleidigte; schimpfte; vergleicht; verglich; titulierte; vorwirft; vorgeworfen; aufzufordern
        ru x: назвал; назвала; назвали; называть; называл; называли; называют; сказал; сказала; скажу; сказать; говорит; говорил; говорить; говорят; угрожал; угрожала; угрожает; угрожать; обозвал; обозвала; обзывал; обвинил; обвиняет; кричал; кричала; крикнул; оскорбил; оскорблял; утверждает; утверждать; утверждал; сравнил; сравнивать; заявил; пообещал
        es x: llamó; llamar; llamado; llamaba; dijo; dice; decir; diga; amenazó; amenazar; amenazado; insultó; insultar; acusó; gritó; afirmó; afirmar; calificó; comparó
        it x: chiamato; chiamare; chiamava; detto; dire; dice; disse; minacciato; minacciare; insultato; insultare; accusato; gridato; affermato; affermare; definito; definire; paragonato; scritto che
        zh x: 说; 称; 骂; 辱骂; 称呼; 说过; 称为; 骂过; 威胁; 声称; 指责; 谩骂; 侮辱; 喊; 宣称; 形容; 比作; 写道; 写着; 表示; 教唆; 煽动; 扬言; 恐吓; 诬称; 被指; 指控
    """,
    # sources and places of speech, which govern only through a link or a quotation
    "CASE": """
        en n: court; judge; jury; prosecutor; police; moderator; policy; rule; film; movie; scene; novel; book; villain; character; actor; song; lyric; article; headline; study; tweet; post; comment; message; email; letter; sentence; phrase; word; expression; example; quote; filter; classifier; dataset; lawsuit; verdict; complaint; lawyer; witness; victim; defendant; suspect; report; transcript; regulation; code; training; handbook; guideline; translation; dictionary; propaganda; slogan; banner; graffiti; editorial; speech; law; act; investigation; hearing; inquiry; historian; researcher; documentary
        en x: fined; convicted; sentenced; banned; arrested; charged; fired; dismissed; deleted; removed; suspended; blocked; wrote; writes; written; posted; tweeted; according to; reportedly; allegedly; such as; apologised; apologized; condemned; forbidden; prohibited; not allowed; must not; wrong to; unacceptable; it is wrong; prohibits; flagged; outlawed; punishable; illegal
        fr n: tribunal; juge; procureur; policier; modérateur; règlement; film; scène; roman; livre; personnage; acteur; chanson; article; titre; étude; tweet; message; commentaire; lettre; phrase; mot; expression; exemple; plainte; avocat; témoin; victime; accusé; tueur; méchant; filtre
        fr x: police; selon; condamné; condamnée; interdit; interdite; interdits; supprimé; supprimés; écrit; écrivait; écrire; licencié; arrêté; faux de; inacceptable; défendu de; puni; loi; charte; passible; signalé
        de n: gericht; richter; staatsanwalt; polizist; moderator; regel; richtlinie; film; szene; roman; buch; mörder; schurke; figur; lied; artikel; studie; tweet; beitrag; kommentar; nachricht; brief; satz; wort; ausdruck; beispiel; klage; anwalt; zeuge; opfer; angeklagt; filter; gesetz; urteil; anzeige; rede
        de x: polizei; laut; verurteilt; verurteilte; verboten; untersagt; gelöscht; gesperrt; entfernt; schrieb; schreibt; geschrieben; gekündigt; entlassen; festgenommen; falsch zu; inakzeptabel; unzulässig; strafbar; angezeigt; gemeldet
        ru n: суд; судь; прокурор; модератор; фильм; сцен; роман; книг; злоде; персонаж; песн; стать; исследовани; твит; сообщени; комментари; письм; фраз; слов; выражени; пример; жалоб; адвокат; свидетел; потерпевш; подсудим; фильтр; закон; правил; приговор
        ru x: полиции; полиция; по данным; оштрафовал; оштрафован; осуждён; осудил; запрещено; запрещается; удалил; удалено; удалены; заблокирован; написал; написала; писал; уволен; уволили; арестован; неверно; недопустимо; судья; осудили; наказан; запрещает
        es n: tribunal; juez; fiscal; moderador; película; escena; novela; libro; personaje; canción; artículo; estudio; mensaje; comentario; carta; frase; palabra; ejemplo; queja; abogado; testigo; víctima; ley; norma
        es x: policía; según; condenó; condenado; prohibido; prohibida; borrado; eliminado; escribir; escribió; escrito; despedido; detenido; inaceptable; multado
        it n: tribunale; giudice; procuratore; moderatore; scena; romanzo; libro; personaggio; canzone; articolo; studio; messaggio; commento; lettera; frase; parola; esempio; avvocato; testimone; vittima; legge; regola
        it x: film; polizia; secondo; condannato; vietato; vietata; rimosso; cancellato; scritto; scrisse; scrivere; licenziato; arrestato; inaccettabile; multato
        zh x: 法院; 法官; 检察; 警方; 公安; 版主; 规定; 制度; 电影; 小说; 剧中; 反派; 角色; 歌词; 文章; 标题; 研究; 帖子; 评论; 消息; 邮件; 句子; 词语; 例如; 举例; 投诉; 律师; 证人; 受害人; 被告; 嫌疑人; 过滤; 条例; 判处; 判决; 罚款; 删除; 屏蔽; 封禁; 封号; 举报; 禁止; 严禁; 不得; 审核; 拘留; 起诉; 开除; 道歉; 谴责; 守则; 培训; 台词; 翻译; 词典; 历史; 宣传
    """,
    "LINK": """
        en x: that; for; because; after; who; whose; which; as; when; with; where; how; to; of; about; containing; against; from
        fr x: que; qu'; pour; parce que; après; qui; dont; où; comme; de; d'
        de x: dass; weil; nachdem; der; die; das; dem; als; wo; wegen; mit; zu; in dem; worin; ob
        ru x: что; за; потому; после; который; где; как; об; за то; якобы
        es x: que; por; porque; tras; quien; donde; como; de
        it x: che; per; perché; dopo; dove; come; di; aver
        zh x: 因; 因为; 中; 里; 内容; 关于; 对; 向; 以; 把; 将; 之类; 等; 后; 在
    """,
    "BUT": """
        en x: but; yet; however; though
        fr x: mais; pourtant; cependant
        de x: aber; sondern; jedoch
        ru x: но; однако; зато
        es x: pero; sino
        it x: ma; però; bensì
        zh x: 但; 但是; 而是; 可是; 不过; 却
    """,
    # harmless compounds that hold words of the lists; they hide what they cover
    "HARMLESS": """
        en x: bastard file; bastard files; cock valve; cock valves; screw fastener; screw fasteners; stop cock; ball cock; strip steel; naked conductor; naked conductors; naked eye; naked wire; naked wires; bare conductor; dumb terminal; dumb terminals; dumb waiter; kill switch; kill switches; kill rate; crude oil; hate-speech; hate speech; sexual harassment; breast imaging; breast cancer; adult incontinence; adult education; sex ratio; sex chromosome; die-casting; die casting; dumping investigation; anti-dumping; vermin control; pest control; rodent and vermin control; guinea pig; guinea pigs; pig iron; pig farm; garbage processing; garbage collection; garbage disposal; garbage collector; trash compactor; trash can; master and slave; slave controller; slave controllers; rat race; parasite drag; ignition retard; fire retardant; oral vaccine; oral dosage; oral report; oral presentation; naked short; nude mice; market penetration; hardcore drilling; stupid mistake; stupid question; damn good; fat tail; cash cow; hot dog; guard dog; bull market; dirty price; dirty data; dead weight; dead end; dead line; fat content; bloody mary; hot rolled; hot water; break even; burn rate; kill process; old people's home; clown fish; black box; black market; black friday; sick leave; cutting head; hang up; strip mall; strip mining; cock pit; wet process; hot spot; hot standby; dick's; cutting fluid; monkey wrench; monkey bars; computer mouse; watch dog; snake oil; poison pill; black hole; chicken shit; beat generation; gay men's health; women's shelter; women's health; zero dirt; the disease; head count; home market; face value; face mask; in your home; house price; house prices; your house number; headcount; second-class citizens; jump start; jump in prices; throw-away; mother company; tool box; machine tool; machine tools; cutting tool; power tool; tool steel
        fr x: harcèlement sexuel; traitement des ordures; élevage de porcs; mise à nu; conducteur nu; câble nu; vieux papiers; gros œuvre; vache à lait; vache folle; tête de série; sale temps; bras de fer; pauvre en; nue-propriété; ordures ménagères
        de x: sexuelle belästigung; müllverbrennung; schweinezucht; schweinefleisch; wildschwein; nackte zahlen; nackte leiter; nackter draht; nackte draht; schwanzflosse; geile preise; krankes haus; krank geschrieben; altes schwein; hund und katze; fauler kredit; faule kredite; schlange stehen; warteschlange; kranke kinder; flasche wein; keine menschen zweiter klasse; menschen zweiter klasse
        ru x: сексуальные домогательства; свиноводство; переработка мусора; голые провода; голый провод; козлы отпущения; грязное производство; жирные кислоты; больные деньги; рак молочной; больной зуб; глупое решение; вор в законе
        es x: acoso sexual; perro guardián; vaca lechera
        it x: molestie sessuali; cane da guardia; vacca da latte
        zh x: 去死角; 死角; 狗年; 狗粮; 热狗; 生猪; 猪肉; 猪瘟; 养猪; 种猪; 垃圾焚烧; 垃圾分类; 垃圾处理; 垃圾发电; 垃圾债; 垃圾桶; 垃圾站; 裸机; 裸眼; 裸露; 裸光纤; 裸芯; 裸导线; 黄色预警; 性价比; 反性骚扰; 性骚扰; 反歧视; 色情信息; 仇恨言论; 操作; 操盘; 操控; 体操; 操纵; 操场; 脱水; 脱硫; 脱硝; 脱脂; 脱贫; 摸底; 摸索; 抚摸屏; 触摸; 床身; 机床; 车床; 矿床; 炮制; 牛奶; 奶粉; 奶业; 杀菌; 杀毒; 杀虫; 杀死; 杀灭; 屠宰; 砍价; 砍伐; 灭菌; 灭火; 灭虫; 上门服务; 害虫防治; 寄生虫病; 无码头; 其他; 吉他; 他山; 他国; 滚动; 滚珠; 滚筒; 滚轮; 滚柱; 滚存; 滚压; 翻滚; 干部; 干净; 干燥; 干扰; 干预; 骨干; 若干; 主干; 干线; 干货; 干法; 饼干; 高层; 打造; 打开; 打印; 打破; 打击; 打包; 打样; 打算; 打通; 打磨; 打款; 打卡; 打电话; 打折; 击打; 拨打; 手机; 手段; 手续; 手册; 手术; 手工; 对手; 助手; 着手; 头部; 头寸; 龙头; 头号; 头条; 码头; 接头; 镜头; 笼头; 源头; 探头; 刀具; 刀片; 刀头; 铣刀; 燃烧; 烧结; 烧碱; 煅烧; 焙烧; 死亡; 死锁; 生死; 老化; 老旧; 老客户; 养老; 老龄; 古老; 堵塞; 封堵; 说明; 说法; 据说; 小说家; 传说; 名称; 宣称力; 简称; 全称; 称重; 对称; 职称; 叫停; 狗年限定; 胸片; 胸外科; 杀价; 砸盘; 砸钱; 揉搓; 插件; 插座; 插入; 插头; 接插; 骑行; 骑车; 共同富裕; 臭氧; 臭味; 除臭; 脏污; 脏水; 心脏; 肝脏; 内脏; 贼市; 皮革; 皮带; 牙科; 牙齿; 脸部; 人脸; 枪机; 喷枪; 焊枪; 水枪; 特别; 别墅; 区别; 级别; 类别; 识别; 个别; 分别; 差别; 别的; 性别; 辨别; 鉴别; 告别; 判别; 在线监测; 在线检测; 在线教育; 视频会议; 视频监控; 像素; 图像; 影像; 成像; 摄像; 录像; 好转; 良好; 偏好; 爱好; 友好; 太阳; 太空; 太平; 真实; 真空; 认真; 传真; 仿真; 真正; 真菌; 全是真; 得到; 取得; 获得; 所得; 获得感; 不得不; 值得; 得益; 得分; 得知; 显得; 使得; 应收; 应付; 应用; 供应; 反应; 响应; 效应; 适应; 相应; 对应; 应急; 应对; 该公司; 该等; 该项; 该批; 该产品; 住宅; 住房; 居住; 入住; 住所; 住院; 小心肝; 的人民; 的人员; 的人才; 的人力; 的人工; 的人均; 的人数; 的人口
    """,
}

#: Simplified characters of the lists, and their traditional forms in the same order.
SIMPLIFIED, TRADITIONAL = (
    "残脑贱杂种骂丑闭废乱头妇乡饭农难们谈块东驴门进别这动滚烧让无码黄约聊裸边观视频级尽话个来条龙随约发给脱货妈妇侮该统关赶药脏绝灭强轮线务里两样让狱狗粮猪类虫岛国断剁价预机单脚带杀从楼跳会场儿哪学见应处决枪毙烂骗谁帮懒爷儿劳资",
    "殘腦賤雜種罵醜閉廢亂頭婦鄉飯農難們談塊東驢門進別這動滾燒讓無碼黃約聊裸邊觀視頻級盡話個來條龍隨約發給脫貨媽婦侮該統關趕藥髒絕滅強輪線務裡兩樣讓獄狗糧豬類蟲島國斷剁價預機單腳帶殺從樓跳會場兒哪學見應處決槍斃爛騙誰幫懶爺兒勞資",
)

#: Characters of insults, and the sound that may be written for them.
SOUNDS = dict(pair.split(":") for pair in (
    "傻:sha 逼:bi 比:bi 屄:bi 王:wang 八:ba 蛋:dan 狗:gou 杂:za 种:zhong 婊:biao 子:zi 贱:jian 人:ren 货:huo 脑:nao 残:can 煞:sha 笔:bi 废:fei 物:wu 白:bai 痴:chi"
    " 蠢:chun 猪:zhu 畜:chu 生:sheng 垃:la 圾:ji 混:hun 智:zhi 障:zhang 渣:zha 败:bai 类:lei 操:cao 草:cao 妈:ma 娘:niang 笨:ben 弱:ruo"
    " 裸:luo 约:yue 炮:pao 骚:sao"
).split())
#: Digits that sound like characters of insults.
DIGITS = {"八": "8", "死": "4", "爱": "2", "二": "2"}


def lines(block: str) -> list[tuple[str, str, list[str]]]:
    """(language, kind, words) of each line of a class."""
    out = []
    for line in block.strip().split("\n"):
        head, _, words = line.strip().partition(": ")
        language, kind = head.split(" ")
        out.append((language, kind, [w.strip() for w in words.split(";") if w.strip()]))
    return out
