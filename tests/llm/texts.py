"""Small texts of our own for the tests."""

LANGUAGE_SAMPLES = {
    "vi": ["Người dân muốn nộp hồ sơ thì đến phường trước ngày mười lăm. Cán bộ tiếp nhận giấy tờ và hẹn ngày trả.", "Đất ở tại xã được đo lại khi có tranh chấp. Hộ gia đình giữ bản sao ít nhất hai năm.", "Trẻ em được tiêm vắc xin tại trạm y tế. Bác sĩ ghi sổ theo dõi từng tháng.", "Xe đi sai làn bị phạt tiền theo quy định. Người lái phải mang giấy phép.", "Chủ nhà xin giấy xác nhận và chờ trả lời trong ba mươi ngày. Kết quả cấp cho hộ dân bị mất sổ.", "Công ty làm lại sổ sách trước khi nộp thuế. Số tiền chậm nộp được tính theo ngày.", "Học sinh đọc sách ở thư viện vào mùa đông. Thầy giáo viết bài và giao việc cho từng bạn."],
    "en": ["The office will check the paper within ten days after the request. People should keep a copy of the record.", "When the licence is missing, the clerk writes to the owner and waits. The fee was paid before the end of the month.", "Anyone who asks about the house must also show the map. According to the note it is not the same.", "In the report there were many cases about the school, and most of them were closed."],
    "fr": ["Le bureau vérifie les papiers dans un délai de dix jours après la demande. Il faut conserver une copie pendant deux ans.", "Les habitants disent que la carte a été modifiée avant le permis. Selon la note, ce n'est pas la même chose.", "Sans le dossier, l'agent écrit au demandeur et attend encore. On a compté beaucoup de cas dans la ville.", "La maison est grande et le jardin est plein de fleurs pour les enfants."],
    "es": ["La oficina revisa los papeles en un plazo de diez días desde la solicitud. Hay que guardar una copia durante dos años.", "Los vecinos dicen que el mapa fue cambiado antes de la licencia. Según la nota, no es lo mismo.", "Si falta el expediente, el empleado escribe al dueño y espera más días. Se contaron muchos casos en la ciudad.", "La casa es grande y el jardín está lleno de flores para los niños."],
    "zh": ["办事处在十天内核对材料，并公布结果。请把证件至少保存两年，因为可能需要复查。", "如果没有登记，工作人员会通知申请人再等。当地居民表示地图已经修改。", "根据说明，两种文件并不相同。今年共有许多材料涉及学校。", "孩子们在公园里玩，老人坐在树下聊天。"],
    "ru": ["Отдел проверяет бумаги в течение десяти дней после запроса. Нужно хранить копию не менее двух лет.", "Жители говорят, что карту изменили раньше. Согласно записке, это не одно и то же.", "Если нет документа, служащий пишет заявителю и ждёт. В этом году было много дел о школе.", "Дети играют в парке, а старики сидят под деревьями."],
}

HELD_OUT = [
    ("vi", "Chủ hộ xin cấp lại sổ bị mất và chờ kết quả trong hai mươi ngày làm việc."),
    ("en", "The teacher said that the children should read the book before the winter."),
    ("vi", "Chu ho xin cap lai so bi mat va cho ket qua trong hai muoi ngay lam viec."),
    ("fr", "Les enfants de la ville doivent lire le livre avant la fin de la semaine."),
    ("es", "Los niños de la ciudad deben leer el libro antes del fin de la semana."),
    ("zh", "学生们应该在冬天之前读完这本书，然后写一篇文章。"),
    ("ru", "Учитель сказал, что дети должны прочитать книгу до зимы и написать ответ."),
]
