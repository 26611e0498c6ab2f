"""Template residue, filler and error-page text (problem 7).

Method: three character n-gram models of residue (unfilled slots, filler, notices) are fitted on the
seed texts below, one of natural prose on the visible text of the whole corpus; per block, windows of
the log-likelihood ratio against prose localise residue, and a page is excluded by coverage. Slots are
compared in the shape of the text (letters become ``x``), so unseen slot names count as well.
N-grams are hashed into ``2**BITS`` cells: the model has a fixed size however large the corpus is, its
counts are summed per task before the shuffle, and only these cells reach the driver.

Only blocks of the main body count (:mod:`main_text`), text in ``code`` or ``pre`` does not, and a
notice in ``noscript`` counts only where the page has no text of its own.

Cases: null or empty html is no residue (no row); an empty table gives an empty prose model and no
rows; repeated deliveries give one row; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.html_scan import scan_blocks, visible_text
from pagestrata.llm.main_text import FEATURES, block_features, main_tree

BITS = 18
_WORDS_AT, _LINK_AT = FEATURES.index("words"), FEATURES.index("link")
CELLS = 1 << BITS
SLOT, FILLER, NOTICE = 0, 1, 2
_BACKOFF = 0.3

# Ways in which template systems write a slot; X stands for a name.
SLOT_FORMS = (
    "{{ X }}", "{{X}}", "{{{X}}}", "{{#X}}", "{{/X}}", "{{> X}}", "{% X %}", "{% block X %}{% endblock %}", "{% if X %}", "{%X%}", "<%= X %>", "<% X %>", "<%X%>", "<?= X ?>", "<?php echo $X; ?>", "${X}", "{$X}", "#{X}", "@{X}", "%{X}", "{!X}",
    "<%- X -%>", "<%- X %>", "{% include 'X' %}", "<%- X('X') %>", "{X_X}", "{X.X}", "[[X]]", "[[+X]]", "[[*X]]", "[X_X]", "[X.X]", "[%X%]", "[% X %]", "%X%", "%%X%%", "%(X)s", "$X$", "@X@", "@@X@@", "__X__", "##X##", "#X#", "<<X>>", "<#X#>", "<!X!>", "~~X~~", "!!X!!", "$(X)",
)
SLOT_NAMES = ("title", "page.title", "post_content", "NAME", "body", "site_name", "user.first_name", "item.description", "HEADLINE_TEXT", "article-body")
# Texts that hold a place for missing content.
SLOT_TEXTS = ("[insert text here]", "[insert title here]", "[your text here]", "[object Object]", "undefined undefined")
# The traditional printer's filler.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum. "
    "sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. "
    "nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. neque porro quisquam est qui dolorem ipsum quia dolor sit amet. "
    "vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. "
    "praesent commodo cursus magna vel scelerisque nisl consectetur et. donec sed odio dui. cras mattis purus sit amet fermentum. aenean lacinia bibendum nulla sed consectetur. nullam quis risus eget urna mollis ornare vel eu leo. "
    "integer posuere erat a ante venenatis dapibus velit aliquet. maecenas faucibus mollis interdum. morbi leo risus porta ac consectetur ac vestibulum at eros. vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor."
)
# Other filler in the languages of the archive and its neighbours.
FILLERS = (
    "your text goes here", "your text here", "text goes here", "add your text here", "enter your text here", "type your text here", "insert your content here", "click here to edit this text", "replace this text with your own", "sample text",
    "placeholder text", "dummy text", "example text", "filler text", "this is a sample page", "this is an example page", "your headline here", "heading goes here", "title goes here", "subtitle goes here", "description goes here", "image caption here",
    "your company name", "name surname, position", "first name last name", "john doe, position", "todo: add description", "todo: add text", "todo: write this section", "tbd", "to be added", "content coming soon", "test test test", "test page", "untitled document",
    "hello world! welcome to your new site. this is your first post. edit or delete it, then start writing!", "undefined. null. nan. n/a", "qwerty asdf zxcv qwerty asdf zxcv", "asdf asdf asdf", "xxx xxx xxx", "the quick brown fox jumps over the lazy dog",
    "тут буде ваш текст", "тут буде текст", "введіть текст", "введіть ваш текст тут", "додайте свій текст", "приклад тексту", "зразок тексту", "текст-заповнювач", "заголовок сторінки", "заголовок тут", "ваш заголовок", "опис з’явиться пізніше", "прізвище ім’я, посада",
    "todo: додати опис", "todo: додати текст", "тестова сторінка", "тест тест тест", "йцукен фівапр ячсмить", "здесь будет ваш текст", "здесь будет текст", "введите текст", "добавьте описание", "пример текста", "текст-заполнитель", "заголовок страницы",
    "фамилия имя, должность", "тестовая страница", "йцукен фывапр ячсмить", "hier steht ihr text", "hier kommt ihr text", "ihr text hier", "fügen sie hier ihren text ein", "text eingeben", "platzhaltertext", "platzhalter", "blindtext", "beispieltext", "mustertext",
    "überschrift hier", "ihre überschrift", "vorname nachname, position", "max mustermann, position", "todo: beschreibung ergänzen", "inhalt folgt", "testseite", "tu wpisz tekst", "tutaj będzie tekst", "twój tekst tutaj", "wpisz swój tekst", "dodaj opis", "przykładowy tekst",
    "tekst zastępczy", "twój nagłówek", "tytuł strony", "imię i nazwisko, stanowisko", "todo: dodać opis", "strona testowa", "此处填写文字", "在此输入内容", "请输入内容", "请在此处添加文字", "示例文本", "占位文本", "这里是标题", "标题在此", "姓名，职务", "待补充", "待添加", "测试页面",
    "ここに文章を入力", "ダミーテキスト", "サンプルテキスト", "votre texte ici", "texte d'exemple", "su texto aquí", "texto de ejemplo", "testo di esempio", "inserisci qui il testo",
)
# What notices are made of, by language: what is missing or down, what has become of it, what follows.
NOTICE_PARTS = (
    (
        ("the page", "this page", "the requested page", "the page you requested", "the page you are looking for", "the page you were looking for", "sorry, the page", "that page", "that link", "the link", "the address", "the requested address", "the requested url", "the document", "the file", "the resource", "this content", "this article", "unfortunately the page", "the page you wanted", "the page you tried to open", "the page you followed a link to", "the item you requested", "this url", "this record"),
        ("was not found", "has gone", "has been taken down", "has been archived", "has been renamed", "never existed", "is missing", "has been permanently removed", "cannot be opened", "could not be loaded", "failed to load", "is empty", "has no content yet", "is restricted", "could not be found", "cannot be found", "can’t be found", "not found", "does not exist", "doesn't exist", "no longer exists", "has been moved", "has been removed", "has been deleted", "may have been moved or deleted", "is not available", "is no longer available", "is broken", "seems to be broken", "has expired", "was not served by this server"),
        ("", "on this server", "please check the address", "go back to the home page", "try searching instead", "sorry for the inconvenience"),
    ),
    (
        ("the site", "this site", "our site", "the website", "our website", "the server", "this server", "the service", "this service", "service", "the system", "the database", "the application", "the portal", "we"),
        ("is temporarily unavailable", "is temporarily closed", "is closed until further notice", "has been shut down", "has been discontinued", "is busy", "is under heavy load", "crashed", "is being upgraded", "is in maintenance mode", "is in read-only mode", "could not be reached", "timed out", "is currently unavailable", "is unavailable", "is temporarily offline", "is offline", "is down", "is down for maintenance", "is undergoing maintenance", "is under maintenance", "is under construction", "is not responding", "is overloaded", "is unable to answer your request", "encountered an error", "is closed for repair", "are down for scheduled maintenance", "will be back soon"),
        ("", "please try again later", "try again in a few minutes", "please come back later", "come back tomorrow", "check back soon", "we apologise for the inconvenience", "thank you for your patience", "we will be back shortly"),
    ),
    (
        ("an error", "an unexpected error", "an internal error", "a server error", "a fatal error", "a database error", "an application error", "sorry, an error", "something"),
        ("has occurred", "occurred", "occurred while processing your request", "went wrong"),
        ("", "please try again later", "contact the administrator", "contact the site administrator", "contact your hosting provider for details", "refresh the page"),
    ),
    (
        ("access", "access to this page", "access to this resource", "your request", "your account", "this account", "your session", "permission", "you do not have permission", "you are not authorized", "authorization", "login", "this area", "this document", "this section", "content", "your ip address", "your computer", "viewing this page"),
        ("denied", "is limited to members", "is for registered users only", "is restricted", "is not permitted", "is password protected", "has been banned", "has been disabled", "is locked", "requires a password", "is forbidden", "forbidden", "has been denied", "has been suspended", "was blocked", "has expired", "is required", "to view this page", "to access this page"),
        ("", "on this server", "please log in", "please log in again", "contact the administrator"),
    ),
    (
        ("we could not find", "we couldn't find", "we cannot find", "sorry, we can't find", "unable to find", "cannot open", "failed to load", "could not load", "unable to load", "cannot display", "unable to display", "could not retrieve", "nothing was found at", "there is nothing at"),
        ("the page", "the page you asked for", "the page you are looking for", "this page", "that page", "the file", "the resource", "the content", "the requested content", "what you were looking for", "this address", "this location", "the template", "the article"),
        ("", "please try again", "check the spelling of the address", "return to the home page", "or it has been removed"),
    ),
    (
        ("you need to", "you must", "you have to", "please", "sorry, you have to", "members only:"),
        ("log in", "sign in", "register", "subscribe", "enter a password", "create an account", "verify your age"),
        ("", "to continue", "to read this page", "to view this content", "to see the rest of this article"),
    ),
    (
        ("could not connect to", "cannot connect to", "unable to connect to", "failed to connect to", "connection lost to", "connection timed out to", "no response from", "bad response from", "timeout while waiting for", "error while reading from"),
        ("the server", "the database", "the database server", "the service", "the host", "the backend", "the upstream server", "mysql", "the network"),
        ("", "try again later", "please refresh the page", "contact support"),
    ),
    (
        ("we are", "the site is", "our website is", "this website is", "this page is", "the page is", "this section is", "sorry, we are"),
        ("currently being updated", "being updated", "being built", "performing maintenance", "closed for maintenance", "currently offline", "working on it", "experiencing technical difficulties", "having technical problems", "not available right now", "moving to a new server", "almost ready", "launching soon", "upgrading our systems"),
        ("", "please visit us again soon", "please visit later", "we will be back online soon", "stay tuned", "please be patient", "sorry for any trouble", "come back in an hour"),
    ),
    (
        ("this content", "this post", "this message", "this video", "this profile", "this item", "this product", "this listing", "this user", "the content"),
        ("is not available", "has been deleted by its author", "has been removed by the moderator", "was deleted", "is private", "is restricted", "cannot be displayed", "is not available in your region", "has expired"),
        ("",),
    ),
    (
        ("please enable javascript", "please turn on javascript", "you need to enable javascript", "javascript is disabled", "javascript is required", "javascript must be enabled", "this page requires javascript", "this site requires javascript", "this page needs scripts", "scripts are disabled", "scripts must be enabled", "please allow scripts", "turn on scripts", "enable cookies and javascript", "your browser does not support javascript", "your browser does not support scripts", "your browser is out of date", "checking your browser", "switch on javascript", "your browser must support javascript", "activate scripts", "scripts are blocked", "this content needs javascript"),
        ("", "in your browser", "in your browser settings", "and reload", "to see the content", "to use it", "to continue", "to view this page", "to run this app", "to use this site", "and reload the page", "and refresh", "before access", "please wait", "and try again"),
        ("",),
    ),
    (
        ("сторінку", "таку сторінку", "запитану сторінку", "запитувану сторінку", "шукану сторінку", "ми не змогли знайти сторінку", "на жаль, сторінку", "вибачте, сторінку", "адресу", "документ", "файл", "матеріал", "за цією адресою нічого"),
        ("не знайдено", "видалено", "переміщено", "було видалено", "видалено або переміщено", "неможливо показати"),
        ("", "перевірте адресу", "поверніться на головну", "на цьому сервері", "скористайтеся пошуком"),
    ),
    (
        ("сторінка", "така сторінка", "запитана сторінка", "на жаль, такої сторінки", "цієї сторінки", "сайт", "наш сайт", "сервер", "сервіс", "портал", "база даних", "ми"),
        ("не існує", "більше не існує", "недоступна", "недоступний", "тимчасово недоступний", "тимчасово не працює", "на технічному обслуговуванні", "на реконструкції", "у розробці", "перевантажений", "не відповідає", "скоро повернемося", "незабаром запрацює"),
        ("", "спробуйте пізніше", "зайдіть пізніше", "вибачте за незручності", "дякуємо за терпіння"),
    ),
    (
        ("помилка", "сталася помилка", "вибачте, сталася помилка", "внутрішня помилка сервера", "помилка з’єднання з базою даних", "доступ заборонено", "доступ обмежено", "обліковий запис призупинено", "сеанс завершено", "увійдіть ще раз", "увімкніть javascript", "для роботи сайту потрібно увімкнути javascript", "ваш браузер не підтримує скрипти", "увімкніть скрипти", "дозвольте скрипти", "перевіряємо ваш браузер", "технічні роботи", "проводяться технічні роботи", "ведуться технічні роботи", "сайт оновлюється", "не вдалося завантажити сторінку", "не вдалося підключитися до сервера", "потрібна авторизація", "необхідно увімкнути скрипти у браузері"),
        ("", "спробуйте пізніше", "зайдіть, будь ласка, пізніше", "спробуйте ще раз", "оновіть сторінку", "і оновіть сторінку", "і перезавантажте сторінку", "зачекайте", "зверніться до адміністратора", "зверніться до хостинг-провайдера"),
        ("",),
    ),
    (
        ("страница", "запрошенная страница", "такой страницы", "к сожалению, страница", "извините, страница", "документ", "файл", "сайт", "наш сайт", "сервер", "сервис", "мы"),
        ("не найдена", "не найден", "не существует", "больше не существует", "удалена", "была удалена или перемещена", "недоступна", "временно недоступен", "временно не работает", "на техническом обслуживании", "в разработке", "на реконструкции", "скоро вернемся"),
        ("", "попробуйте позже", "зайдите позже", "приносим извинения за неудобства", "проверьте адрес", "вернитесь на главную"),
    ),
    (
        ("ошибка", "произошла ошибка", "внутренняя ошибка сервера", "ошибка соединения с базой данных", "доступ запрещен", "аккаунт заблокирован", "включите javascript", "для работы сайта необходимо включить javascript", "ваш браузер не поддерживает скрипты", "технические работы", "проводятся технические работы", "ведутся технические работы", "сайт обновляется", "не удалось загрузить страницу", "не удалось подключиться к серверу", "требуется авторизация"),
        ("", "попробуйте позже", "обновите страницу", "подождите", "обратитесь к администратору"),
        ("",),
    ),
    (
        ("die seite", "diese seite", "die angeforderte seite", "die gewünschte seite", "die gesuchte seite", "seite", "das dokument", "die datei", "die adresse", "der link", "der inhalt", "die website", "unsere website", "der server", "der dienst", "die datenbank", "wir"),
        ("wurde nicht gefunden", "konnte nicht gefunden werden", "nicht gefunden", "existiert nicht", "existiert leider nicht", "existiert nicht mehr", "wurde verschoben", "wurde gelöscht oder verschoben", "ist nicht verfügbar", "ist vorübergehend nicht verfügbar", "ist derzeit nicht erreichbar", "ist wegen wartungsarbeiten nicht erreichbar", "ist im aufbau", "ist überlastet", "antwortet nicht", "sind bald zurück"),
        ("", "bitte versuchen sie es später erneut", "bitte prüfen sie die adresse", "zurück zur startseite", "wir bitten um entschuldigung"),
    ),
    (
        ("fehler", "ein fehler ist aufgetreten", "entschuldigung, ein fehler ist aufgetreten", "interner serverfehler", "fehler beim verbinden mit der datenbank", "zugriff verweigert", "zugriff verboten", "dieses konto wurde gesperrt", "sitzung abgelaufen", "wartungsarbeiten", "bitte aktivieren sie javascript", "javascript ist deaktiviert", "ihr browser unterstützt kein javascript", "ihr browser unterstützt keine skripte", "skripte sind nötig", "ihr browser wird geprüft", "diese seite benötigt javascript", "die seite wird gerade gewartet", "die webseite wird gewartet", "wir führen wartungsarbeiten durch", "leider konnte die gesuchte seite nicht gefunden werden", "die seite konnte nicht geladen werden", "verbindung zum server fehlgeschlagen", "anmeldung erforderlich"),
        ("", "bitte versuchen sie es später erneut", "bitte besuchen sie uns später", "bitte kommen sie später wieder", "um diese seite zu sehen", "und laden sie die seite neu", "bitte warten", "bitte melden sie sich an", "wenden sie sich an den anbieter"),
        ("",),
    ),
    (
        ("strona", "taka strona", "ta strona", "żądana strona", "szukana strona", "nie znaleziono strony", "przepraszamy, strona", "dokument", "plik", "adres", "link", "serwis", "nasz serwis", "serwer", "usługa", "baza danych"),
        ("", "nie została znaleziona", "nie istnieje", "już nie istnieje", "została usunięta", "została przeniesiona", "jest niedostępna", "jest niedostępny", "jest chwilowo niedostępny", "jest w budowie", "jest przeciążony", "nie odpowiada", "wkrótce wracamy"),
        ("", "spróbuj ponownie później", "sprawdź adres", "wróć na stronę główną", "przepraszamy za utrudnienia"),
    ),
    (
        ("błąd", "wystąpił błąd", "przepraszamy, wystąpił błąd", "wewnętrzny błąd serwera", "błąd połączenia z bazą danych", "dostęp zabroniony", "odmowa dostępu", "brak dostępu", "konto zostało zawieszone", "sesja wygasła", "przerwa techniczna", "prace konserwacyjne", "włącz obsługę javascript", "aby zobaczyć tę stronę, włącz javascript", "twoja przeglądarka nie obsługuje skryptów", "włącz skrypty", "sprawdzamy twoją przeglądarkę", "ta strona wymaga javascript", "trwają prace techniczne", "strona w trakcie aktualizacji", "serwis jest tymczasowo wyłączony", "nie odnaleziono strony", "strony nie odnaleziono", "nie udało się załadować strony", "brak połączenia z serwerem", "wymagane logowanie"),
        ("", "spróbuj ponownie później", "zapraszamy później", "prosimy spróbować później", "odśwież stronę", "i odśwież stronę", "poczekaj", "zaloguj się ponownie", "skontaktuj się z administratorem"),
        ("",),
    ),
    (
        ("页面", "该页面", "您访问的页面", "您要查找的页面", "抱歉，您访问的页面", "抱歉，找不到您要的页面", "对不起，您要的页面", "找不到页面", "找不到该页面", "网页", "链接", "文件", "网站", "本站", "服务器", "服务", "系统"),
        ("", "不存在", "未找到", "没有找到", "无法显示", "无法打开", "正在升级", "系统维护中", "升级维护", "找不到", "已被删除", "已删除或移动", "已失效", "暂时不可用", "暂时无法访问", "无法访问", "正在维护", "维护中", "正在建设中", "繁忙", "出错"),
        ("", "请稍后再试", "请稍后重试", "请稍后访问", "请稍后再来", "请检查网址", "返回首页", "给您带来不便敬请谅解"),
    ),
    (
        ("错误", "出错了", "发生错误", "服务器内部错误", "数据库连接错误", "访问被拒绝", "禁止访问", "权限不足", "账户已被暂停", "登录已过期", "请启用javascript", "请开启javascript", "您的浏览器不支持脚本", "您的浏览器不支持javascript", "需要启用脚本", "正在检查您的浏览器"),
        ("", "请稍后再试", "请刷新页面", "以查看此页面", "后刷新页面", "请稍候", "请联系管理员", "请重新登录"),
        ("",),
    ),
    (
        ("page", "la page", "cette page", "la página", "esta página", "la pagina", "ページ", "お探しのページ"),
        ("introuvable", "n'existe pas", "est introuvable", "no encontrada", "no existe", "non trovata", "non esiste", "が見つかりません", "は存在しません"),
        ("",),
    ),
)
# Lines of web servers and of programs that failed.
FAILURES = (
    "oops! that page can’t be found.", "oops, something went wrong", "error 404", "404 error", "error 500", "http error 503", "error code: 502", "http status 404 – not found", "http status 500 – internal server error", "nginx", "nginx/1.18.0", "nginx/1.2", "apache/2.4.41 (ubuntu) server at localhost port 80",
    "apache server at port 443", "lighttpd/1.4", "microsoft-iis/10.0", "server/1.0", "ray id: 0", "index of /", "it works!", "welcome to nginx!", "default web site page", "this domain is parked", "this domain is for sale", "website coming soon", "coming soon", "under construction", "page under construction", "page unavailable", "site unavailable", "login required", "maintenance mode", "error establishing a database connection",
    "there has been a critical error on this website.", "briefly unavailable for scheduled maintenance. check back in a minute.", "the server encountered an internal error or misconfiguration and was unable to complete your request.", "you don't have permission to access / on this server.",
    "the server is temporarily unable to service your request due to maintenance downtime or capacity problems. please try again later.", "additionally, a 404 not found error was encountered while trying to use an errordocument to handle the request.", "please wait while we verify your browser", "ddos protection",
    "warning: include(/var/www/html/page.php): failed to open stream: no such file or directory in /var/www/html/index.php on line 12", "warning: require_once(config.php): failed to open stream: no such file or directory in /home/user/public_html/index.php on line 3",
    "warning: mysql_connect(): access denied for user 'root'@'localhost' (using password: no) in /var/www/html/db.php on line 5", "warning: division by zero in /usr/share/php/file.php on line 44", "warning: cannot modify header information - headers already sent by (output started at /home/site/index.php:1)",
    "notice: undefined index: id in /var/www/html/view.php on line 27", "notice: undefined variable: title in /home/site/template.php on line 8", "deprecated: function split() is deprecated in /var/www/lib.php on line 9", "fatal error: call to undefined function get_header() in /var/www/html/index.php on line 1",
    "fatal error: uncaught error: call to undefined method page::render() in /var/www/html/page.php:30", "fatal error: allowed memory size of 134217728 bytes exhausted (tried to allocate 20480 bytes) in /var/www/html/image.php on line 61", "fatal error: maximum execution time of 30 seconds exceeded",
    "parse error: syntax error, unexpected end of file in /var/www/html/functions.php on line 80", "stack trace: #0 /var/www/html/index.php(17): main() #1 {main} thrown in /var/www/html/index.php on line 17", "sqlstate[hy000] [2002] connection refused", "sqlstate[42s02]: base table or view not found: 1146 table 'db.posts' doesn't exist",
    "you have an error in your sql syntax; check the manual that corresponds to your mysql server version for the right syntax to use near '' at line 1", "mysql server has gone away", "too many connections", "pg_connect(): unable to connect to postgresql server", "ora-00942: table or view does not exist",
    "traceback (most recent call last): file \"/usr/lib/python3/site.py\", line 12, in render return template[name] keyerror: 'title'", "typeerror: 'nonetype' object is not subscriptable", "valueerror: invalid literal for int() with base 10: ''", "attributeerror: 'str' object has no attribute 'get'", "templatedoesnotexist at /",
    "exception in thread \"main\" java.lang.nullpointerexception at com.example.web.page.render(page.java:42) at java.lang.thread.run(thread.java:748)", "java.lang.illegalstateexception: no such element at org.example.servlet.dispatch(servlet.java:101)", "java.io.filenotfoundexception: /opt/app/page.html (no such file or directory)",
    "java.lang.classcastexception: value cannot be cast", "java.lang.noclassdeffounderror: javax/servlet/filter at java.lang.classloader.loadclass(classloader.java:418)", "java.net.connectexception: connection refused at java.net.socket.connect(socket.java:589)", "javax.servlet.servletexception: error in page", "caused by: java.sql.sqlexception: connection closed", "server error in '/' application. runtime error", "system.nullreferenceexception: object reference not set to an instance of an object. at default.page_load(object sender, eventargs e) in c:\\inetpub\\wwwroot\\default.aspx.cs:line 20",
    "uncaught typeerror: cannot read property 'title' of undefined at app.js:1:2", "uncaught referenceerror: $ is not defined at index.js:10", "referenceerror: angular is not defined", "referenceerror: window is not defined", "syntaxerror: unexpected token < in json at position 0", "rangeerror: maximum call stack size exceeded", "nameerror: name 'page' is not defined", "importerror: no module named site", "indexerror: list index out of range", "error: cannot find module 'express'", "undefined method `name' for nil:nilclass", "actioncontroller::routingerror (no route matches [get] \"/page\")", "segmentation fault (core dumped)",
)


def notices() -> list[str]:
    """Texts of error pages and notices: the reason phrases of the web's protocol, lines of failed programs, and sentences of the parts above.

    Sentences are drawn so that every part stands beside several others, each about as often.
    """
    out = [f"{s.value} {s.phrase}".lower() for s in HTTPStatus if s.value >= 400] + [f"{s.phrase}. {s.description}".lower() for s in HTTPStatus if s.value >= 400]
    out += [f"error {s.value}: {s.phrase}".lower() for s in HTTPStatus if s.value >= 400] + list(FAILURES) * 3
    for subjects, states, ends in NOTICE_PARTS:
        for i in range(3 * max(len(subjects), len(states), len(ends))):
            subject, state, end = subjects[i % len(subjects)], states[(i + i // len(subjects) * 7) % len(states)], ends[i * 5 % len(ends)]
            wide = subject[0] > "\u2e00"  # scripts without blanks
            out.append(f"{subject}{'' if wide else ' '}{state}".strip() + (("，" if wide else ". ") + end if end else ""))
    return out


_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(maxsize=2)
def _folding(shape: bool) -> np.ndarray:
    """By code point of the basic plane: lower case with digits as 0, or for shapes letters as x and digits as 0."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isdigit():
            out[c] = 48
        elif shape:
            if x.isalpha():
                out[c] = 120
        elif len(x.lower()) == 1:
            out[c] = ord(x.lower())
    return out


def _codes(text: str, shape: bool) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _folding(shape)
    if len(codes) and codes.max() > 0xFFFF:
        return np.where(codes > 0xFFFF, np.uint32(120) if shape else codes, table[np.minimum(codes, 0xFFFF)])
    return table[codes]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The cell of the 4-gram that ends at each position; before the text stand blanks."""
    padded = np.concatenate([np.full(3, 32, np.uint32), codes])
    h = padded[3:] * _FACTORS[0]
    for k in (1, 2, 3):
        h ^= (padded[3 - k : len(padded) - k] * _FACTORS[k]) >> np.uint32(k)
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def _count(texts: list[str], shape: bool) -> np.ndarray:
    out = np.zeros(CELLS)
    for t in texts:
        out += np.bincount(_grams(_codes(f" {t} ", shape)), minlength=CELLS)
    return out


def _seed_slots() -> list[str]:
    return [f.replace("X", n) for f in SLOT_FORMS for n in SLOT_NAMES] + list(SLOT_TEXTS) * 8


def prose_counts(pages: DataFrame, html_col: str = "html") -> tuple[np.ndarray, np.ndarray]:
    """Cells of plain 4-grams and of shape 4-grams over the visible text of all pages."""

    def run(batches):
        plain, shape = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                text = "\n".join(" ".join(visible_text(x).split()) for x in batch.column(0).slice(start, 256).to_pylist() if x)
                if text:
                    plain += np.bincount(_grams(_codes(text, False)), minlength=CELLS)
                    shape += np.bincount(_grams(_codes(text, True)), minlength=CELLS)
        for kind, counts in enumerate((plain, shape)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at + kind * CELLS, pa.int32()), pa.array(counts[at], pa.int64())], names=["cell", "n"])

    rows = pages.select(html_col).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * CELLS)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out[:CELLS], out[CELLS:]


def ratio_tables(plain: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood ratios by cell of slots (shape), filler and notices (plain) against prose.

    A residue model backs off to prose with weight ``_BACKOFF``: an n-gram that no seed has speaks against residue.
    """

    def ratio(res: np.ndarray, prose: np.ndarray) -> np.ndarray:
        q = np.maximum((prose + 0.02) / (prose.sum() + 0.02 * CELLS), 2e-7)
        return np.clip(np.log((1 - _BACKOFF) * res / res.sum() / q + _BACKOFF), -4, 7).astype(np.float32)

    return ratio(_count(_seed_slots(), True), shape), ratio(_count([*LOREM.split(". "), *FILLERS], False), plain), ratio(_count(notices(), False), plain)


def coverage(texts: list[str], tables: tuple[np.ndarray, np.ndarray, np.ndarray], window: int = 14, level: float = 0.8) -> np.ndarray:
    """For each text: greatest slot window sum, share of the text in filler windows, share in notice windows."""
    out = np.zeros((len(texts), 3))
    if not texts:
        return out
    padded = [f" {t} " for t in texts]
    worded = np.array([sum(map(str.isalpha, t[:200])) >= 2 or sum(map(str.isalpha, t)) >= 2 for t in texts])
    sizes = np.array([len(t) for t in padded])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = "".join(padded)
    ends = np.repeat(starts + sizes, sizes)
    place = np.arange(len(ends))
    reach = np.minimum(place + window, ends)  # windows end with their text
    whole = (reach - place == window) | (place == np.repeat(starts, sizes))  # shorter texts are one window
    plain = _grams(_codes(joined, False))
    slots = np.concatenate([[0.0], np.cumsum(tables[0][_grams(_codes(joined, True))], dtype=np.float64)])
    out[:, 0] = np.maximum.reduceat(np.where(whole, slots[reach] - slots[place], -99.0), starts)
    for k in (1, 2):
        total = np.concatenate([[0.0], np.cumsum(tables[k][plain], dtype=np.float64)])
        at = np.flatnonzero(whole & (total[reach] - total[place] > level * (reach - place)))
        if not len(at):
            continue
        hit = np.bincount(at, minlength=len(place) + 1) - np.bincount(reach[at], minlength=len(place) + 1)
        out[:, k] = np.where(worded, np.add.reduceat(np.cumsum(hit)[:-1] > 0, starts) / sizes, 0)  # a bare number is no notice
    return out


def is_residue(found: np.ndarray, slot_sum: float = 18.5, share: float = 0.78) -> np.ndarray:
    """Whether texts of this coverage are residue: a slot anywhere, or filler or notices over most of it.

    Prose quotes notices at length but not filler, so three quarters of the share is enough for filler.
    """
    return (found[:, 0] > slot_sum) | (found[:, 1] >= 0.75 * share) | (found[:, 2] >= share)


_NOSCRIPT = re.compile(r"(?is)<noscript\b[^>]*+(?:>|\Z)(.*?)(?:</noscript\s*+>|\Z)")
_SILENT = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|title|head)\b.*?(?:</\1\s*+>|\Z)")


def residue_pages(pages: list[str | None], tables, tree, slot_sum: float = 18.5, share: float = 0.78) -> list[bool]:
    """For each page, whether residue stands in place of its content, or of a part of it."""
    out = [False] * len(pages)
    texts, owners, scanned = [], [], {}
    for i, page in enumerate(pages):
        blocks = scan_blocks(page)
        live = [j for j, b in enumerate(blocks) if b.parts and not b.code_chars]
        if any(b.parts for b in blocks):
            scanned[i] = blocks
            for j in live:
                text = blocks[j].text
                if text:
                    texts.append(text)
                    owners.append((i, j))
        elif page:
            body = " ".join(visible_text(_SILENT.sub(" ", page)).split())
            if len(body) < 40:  # nothing but odds and ends: then a notice for browsers without scripts stands alone
                body = " ".join(_html.unescape(re.sub(r"<[^>]*+(?:>|\Z)", " ", " ".join(_NOSCRIPT.findall(page)))).split()) or body
            if body:
                texts.append(body)
                owners.append((i, -1))
    suspects: dict[int, list[int]] = {}
    distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    yes = is_residue(coverage(list(distinct), tables), slot_sum, share)
    for k in [k for k, t in enumerate(texts) if yes[distinct[t]]]:
        suspects.setdefault(owners[k][0], []).append(owners[k][1])
    for i, places in suspects.items():
        if i not in scanned:
            out[i] = True
            continue
        x = np.array(block_features(scanned[i]))
        keep = tree.predict(x) >= 0.5
        # Without any longer plain block in the main body there is no content: then a notice beside the furniture stands in its place.
        empty = not (keep & (x[:, _WORDS_AT] >= 12) & (x[:, _LINK_AT] < 0.5)).any()
        out[i] = any(keep[j] or empty and x[j, _LINK_AT] < 0.5 for j in places)
    return out


def find_residue(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", slot_sum: float = 18.5, share: float = 0.78) -> DataFrame:
    """(id) of every page to exclude, once each."""
    tables = ratio_tables(*prose_counts(pages, html_col))
    tree = main_tree()
    key_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = residue_pages(part.column(1).to_pylist(), tables, tree, slot_sum, share)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(got, pa.bool_()))], names=[id_col])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {key_type}").distinct()
